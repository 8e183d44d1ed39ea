"""Quality and profiling operators Q1-Q15 on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .basics import LI_NULL, li_null
from .registry import register, rounded, table

LI_GROUPS = {"amount": ["l_quantity", "l_extendedprice"], "price_terms": ["l_discount", "l_tax"]}


@register("q1_profile_columns", """SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(c_custkey) AS non_null, round(100.0 * (count(*) - count(c_custkey)) / count(*), 6) AS null_pct,
  count(DISTINCT c_custkey) AS n_distinct, CAST(min(c_custkey) AS DOUBLE) AS min, CAST(max(c_custkey) AS DOUBLE) AS max, round(avg(c_custkey), 6) AS mean, round(stddev_samp(c_custkey), 6) AS std,
  CAST(NULL AS INTEGER) AS min_len, CAST(NULL AS INTEGER) AS max_len FROM customer
UNION ALL SELECT 'c_name', 'string', count(c_name), round(100.0 * (count(*) - count(c_name)) / count(*), 6), count(DISTINCT c_name), NULL, NULL, NULL, NULL, CAST(min(length(c_name)) AS INTEGER), CAST(max(length(c_name)) AS INTEGER) FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal), round(100.0 * (count(*) - count(c_acctbal)) / count(*), 6), count(DISTINCT c_acctbal), min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 6), round(stddev_samp(c_acctbal), 6), NULL, NULL FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), round(100.0 * (count(*) - count(c_mktsegment)) / count(*), 6), count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL, CAST(min(length(c_mktsegment)) AS INTEGER), CAST(max(length(c_mktsegment)) AS INTEGER) FROM customer""")
def q1(spark, sf):
    c = table(spark, sf, "customer")
    return rounded(Q.profile_columns(c, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]))


def _miss_rows(src, name, cols):
    n = len(cols)
    total = " + ".join(f"count(*) - count({c})" for c in cols)
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dataset, '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, "
        f"round(100.0 * ({total}) / (count(*) * {n}), 6) AS dataset_missing_pct FROM {src}" for c in cols)


@register("q2_missing_report", f"WITH {LI_NULL} " + _miss_rows("li", "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag"])
          + " UNION ALL " + _miss_rows("supplier", "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]))
def q2(spark, sf):
    return rounded(Q.missing_report({"lineitem": li_null(spark, sf), "supplier": table(spark, sf, "supplier")}))


@register("q3_id_candidates", """WITH c AS (SELECT 'l_orderkey' AS "column", count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
  UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem)
SELECT "column", n_distinct, CAST(row_number() OVER (ORDER BY n_distinct DESC, "column") = 1 AS INTEGER) AS is_best FROM c""")
def q3(spark, sf):
    return Q.id_candidates(table(spark, sf, "lineitem"))


def _q4_sql(src, cols):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(count(try_cast(trim({e}) AS TIMESTAMP))::DOUBLE / count({e}), 6) AS parse_share,
  {int('date' in c)} AS name_hint, CAST({int('date' in c)} = 1 OR count(try_cast(trim({e}) AS TIMESTAMP)) >= 0.8 * count({e}) AS INTEGER) AS is_candidate FROM {src}""" for c, e in cols.items())


@register("q4_date_candidates", _q4_sql("documents", {c: c for c in ("text", "lang", "source")}))
def q4(spark, sf):
    return rounded(Q.date_candidates(table(spark, sf, "documents"), 0.8))


@register("q4_date_candidates_orders", _q4_sql("orders", {"ordered": "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}))
def q4b(spark, sf):
    """The order date as text, beside the other text columns."""
    o = table(spark, sf, "orders")
    return rounded(Q.date_candidates(o.select(F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("ordered"), "o_orderstatus", "o_orderpriority"), 0.8))


@register("q5_date_ranges", """SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min_date, max(l_shipdate) AS max_date, count(l_shipdate) AS valid_dates, count(*) - count(l_shipdate) AS missing_dates FROM lineitem
UNION ALL SELECT 'commit', min(c), max(c), count(c), count(*) - count(c) FROM (SELECT CASE WHEN l_orderkey % 4 <> 0 THEN l_shipdate END AS c FROM lineitem)""")
def q5(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("commit", F.when(F.col("l_orderkey") % 4 != 0, F.col("l_shipdate")))
    return Q.date_ranges(li, ["l_shipdate", "commit"])


@register("q6_validate_table", """WITH t AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders),
d AS (SELECT sum(c - 1) AS dup FROM (SELECT count(*) c FROM t GROUP BY o_custkey, o_orderstatus, o_orderpriority)),
m AS (SELECT count(*) FILTER (WHERE n > 1) AS ms FROM (SELECT count(*) n FROM t GROUP BY o_custkey))
SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM t)::DOUBLE), ('columns', 3.0), ('subjects', (SELECT count(DISTINCT o_custkey) FROM t)::DOUBLE),
 ('missing_cells', 0.0), ('missing_pct', 0.0), ('sparse_columns', 0.0), ('duplicate_rows', (SELECT dup FROM d)::DOUBLE),
 ('duplicate_subjects', (SELECT ms FROM m)::DOUBLE)) v(metric, value)""")
def q6(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return rounded(Q.validate_table(o, "o_custkey"))


@register("q7_modality_completeness", f"""WITH {LI_NULL}, s AS (SELECT count(l_quantity)::DOUBLE / count(*) AS q, count(l_extendedprice)::DOUBLE / count(*) AS e,
  count(l_discount)::DOUBLE / count(*) AS d, count(l_tax)::DOUBLE / count(*) AS t FROM li)
SELECT 'amount' AS modality, 2 AS n_columns, round((q + e) / 2, 6) AS mean_completeness, round(least(q, e), 6) AS min_completeness, round(greatest(q, e), 6) AS max_completeness FROM s
UNION ALL SELECT 'price_terms', 2, round((d + t) / 2, 6), round(least(d, t), 6), round(greatest(d, t), 6) FROM s""")
def q7(spark, sf):
    return rounded(Q.modality_completeness(li_null(spark, sf), LI_GROUPS))


@register("q8_feature_quality", f"""WITH {LI_NULL},
b AS (SELECT 100.0 * (1 - (count(*) * 8 - count(l_orderkey) - count(l_linenumber) - count(l_partkey) - count(l_quantity) - count(l_discount) - count(l_tax) - count(l_extendedprice) - count(l_returnflag)) / (count(*) * 8.0)) AS c0 FROM li),
a AS (SELECT 100.0 * (1 - (count(*) * 4 - count(l_orderkey) - count(l_quantity) - count(l_discount) - count(l_extendedprice)) / (count(*) * 4.0)) AS c1,
  var_samp(l_orderkey) v0, var_samp(l_quantity) v1, var_samp(l_discount) v2, avg(l_extendedprice) tm, stddev_samp(l_extendedprice) ts,
  skewness(l_extendedprice) tk, max(l_extendedprice) - min(l_extendedprice) tr FROM li)
SELECT metric, round(value, 6) AS value FROM (SELECT * FROM (VALUES ('completeness_before', (SELECT c0 FROM b)), ('completeness_after', (SELECT c1 FROM a)),
 ('completeness_gain', (SELECT c1 FROM a) - (SELECT c0 FROM b)), ('features_before', 8.0), ('features_after', 4.0), ('reduction_ratio', 0.5),
 ('mean_variance', (SELECT (v0 + v1 + v2) / 3 FROM a)), ('min_variance', (SELECT least(v0, v1, v2) FROM a)), ('max_variance', (SELECT greatest(v0, v1, v2) FROM a)),
 ('zero_variance_features', 0.0), ('target_mean', (SELECT tm FROM a)), ('target_std', (SELECT ts FROM a)), ('target_skew', (SELECT tk FROM a)),
 ('target_range', (SELECT tr FROM a))) v(metric, value))""")
def q8(spark, sf):
    before = li_null(spark, sf)
    after = before.select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    return rounded(Q.feature_quality(before, after, "l_extendedprice"))


@register("q9_final_checks", """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders),
a AS (SELECT count(*) n, count(o_totalprice) tv, (count(*) - count(status))::DOUBLE AS miss FROM t),
bal AS (SELECT min(c)::DOUBLE / max(c) AS b FROM (SELECT count(*) c FROM t WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority))
SELECT rule, level, round(value, 6) AS value, passed FROM (VALUES
 ('target_valid_rows', 'issue', (SELECT tv FROM a)::DOUBLE, CAST((SELECT tv FROM a) > 0 AS INTEGER)),
 ('target_valid_share', 'warning', (SELECT tv::DOUBLE / n FROM a), CAST((SELECT tv >= n * 0.5 FROM a) AS INTEGER)),
 ('zero_variance_features', 'warning', 0.0, 1),
 ('completeness_pct', 'warning', (SELECT 100.0 * (1 - miss / (n * 4)) FROM a), CAST((SELECT 100.0 * (1 - miss / (n * 4)) >= 70 FROM a) AS INTEGER)),
 ('duplicate_rows', 'warning', 0.0, 1),
 ('category_balance', 'warning', (SELECT b FROM bal), CAST((SELECT b >= 0.1 FROM bal) AS INTEGER))) v(rule, level, value, passed)""")
def q9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                          F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))
    return rounded(Q.final_checks(o, "o_totalprice", "o_orderpriority"))


@register("q10_modelling_quality", f"""WITH {LI_NULL}, t AS (SELECT l_quantity, l_discount, l_tax, l_returnflag FROM li),
d AS (SELECT sum(c - 1) AS dup FROM (SELECT count(*) c FROM t GROUP BY l_quantity, l_discount, l_tax, l_returnflag))
SELECT metric, round(value, 6) AS value FROM (VALUES ('rows', (SELECT count(*) FROM t)::DOUBLE), ('features', 3.0),
 ('target_missing', (SELECT count(*) - count(l_quantity) FROM t)::DOUBLE),
 ('mean_missing_pct', (SELECT (100.0 * (count(*) - count(l_discount)) / count(*) + 100.0 * (count(*) - count(l_tax)) / count(*) + 0.0) / 3 FROM t)),
 ('duplicate_rows', (SELECT dup FROM d)::DOUBLE),
 ('constant_features', (SELECT CAST(count(DISTINCT l_discount) <= 1 AS INTEGER) + CAST(count(DISTINCT l_tax) <= 1 AS INTEGER) + CAST(count(DISTINCT l_returnflag) <= 1 AS INTEGER) FROM t)::DOUBLE)) v(metric, value)""")
def q10(spark, sf):
    t = li_null(spark, sf).select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return rounded(Q.modelling_quality(t, "l_quantity"))


@register("q11_select_features", f"""WITH {LI_NULL}, c AS (
  SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS corr, count(*) FILTER (WHERE l_quantity IS NOT NULL) AS n_obs, 0 AS pattern_match FROM li
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice), count(*) FILTER (WHERE l_discount IS NOT NULL), 1 FROM li
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice), count(*) FILTER (WHERE l_tax IS NOT NULL), 0 FROM li)
SELECT feature, round(corr, 6) AS corr, n_obs, pattern_match, CAST(coalesce(abs(corr) >= 0.1 AND n_obs >= 10, false) AS INTEGER) AS by_corr FROM c
WHERE coalesce(abs(corr) >= 0.1 AND n_obs >= 10, false) OR pattern_match = 1""")
def q11(spark, sf):
    return rounded(Q.select_features(li_null(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                     0.1, 10, patterns=["disc"]))


@register("q12_imbalance_ratio", "SELECT max(c) AS max_class, min(c) AS min_class, round(max(c)::DOUBLE / min(c), 6) AS imbalance_ratio FROM (SELECT count(*) c FROM lineitem GROUP BY l_returnflag)")
def q12(spark, sf):
    return rounded(Q.imbalance_ratio(table(spark, sf, "lineitem"), "l_returnflag"))


@register("q13_describe_exact", f"""WITH {LI_NULL} SELECT 'l_quantity' AS "column", count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
  min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75, max(l_quantity) AS max FROM li
UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), round(quantile_cont(l_discount, 0.25), 6),
  round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.75), 6), max(l_discount) FROM li""")
def q13(spark, sf):
    return rounded(Q.describe_exact(li_null(spark, sf), ["l_quantity", "l_discount"]))


def _mcorr_sql():
    cols = ["l_quantity", "l_discount", "l_tax"]
    ind = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}" for c in cols)
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS corr FROM m")
            else:
                parts.append(f"SELECT '{a}', '{b}', round(corr({a}, {b}), 6) FROM m")
    return f"WITH {LI_NULL}, m AS (SELECT {ind} FROM li) " + " UNION ALL ".join(parts)


@register("q14_missing_corr", _mcorr_sql())
def q14(spark, sf):
    return rounded(Q.missing_corr(li_null(spark, sf), ["l_quantity", "l_discount", "l_tax"]))


@register("q15_modality_summary", f"""WITH {LI_NULL} SELECT 'amount' AS modality, 2 AS n_features, 2 AS n_numeric, count(*) AS records,
  round((100.0 * (count(*) - count(l_quantity)) / count(*) + 100.0 * (count(*) - count(l_extendedprice)) / count(*)) / 2, 6) AS missing_pct FROM li
UNION ALL SELECT 'price_terms', 2, 2, count(*), round((100.0 * (count(*) - count(l_discount)) / count(*) + 100.0 * (count(*) - count(l_tax)) / count(*)) / 2, 6) FROM li""")
def q15(spark, sf):
    return rounded(Q.modality_summary(li_null(spark, sf), LI_GROUPS))
