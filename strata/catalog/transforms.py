"""Imputation and scaling operators T1-T18.

kNN bindings use ``customer`` joined to its per-customer order aggregates:
features = account balance (null when key % 5 = 0), nation key, number of
orders, mean order price / 1000 (null when key % 7 = 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import scale as S
from .basics import LI_NULL, li_null
from .registry import register, rounded, table


def cust_features(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                                            F.avg("o_totalprice").alias("_p"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select("c_custkey", "c_mktsegment",
                    F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("acctbal"),
                    F.col("c_nationkey").cast("double").alias("nation"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("double").alias("n_orders"),
                    F.when(F.col("c_custkey") % 7 != 0, F.col("_p") / 1000).alias("price"))


CUST = """cf AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS acctbal,
  CAST(c_nationkey AS DOUBLE) AS nation, CAST(coalesce(n_orders, 0) AS DOUBLE) AS n_orders,
  CASE WHEN c_custkey % 7 <> 0 THEN p / 1000 END AS price
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS p FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"""

FEATS = ["acctbal", "nation", "n_orders", "price"]


def _knn_sql(group: bool = False, feats=FEATS, src: str = "", extra: str = "") -> str:
    present = " + ".join(f"CAST(r.{f} IS NOT NULL AND d.{f} IS NOT NULL AS INTEGER)" for f in feats)
    ss = " + ".join(f"coalesce((r.{f} - d.{f}) * (r.{f} - d.{f}), 0)" for f in feats)
    geq = "AND r.c_mktsegment = d.c_mktsegment" if group else ""
    parts = []
    for t in ("acctbal", "price"):
        parts.append(f"""k_{t} AS (SELECT rk, avg(v) AS fill FROM (SELECT r.c_custkey AS rk, d.{t} AS v,
   row_number() OVER (PARTITION BY r.c_custkey ORDER BY sqrt(({ss}) * {float(len(feats))} / ({present})), d.c_custkey) AS rn
   FROM {src or 'cf'} r JOIN {src or 'cf'} d ON r.{t} IS NULL AND d.{t} IS NOT NULL AND ({present}) > 0 {geq}) WHERE rn <= 5 GROUP BY rk)""")
    made = f"{src} AS ({SPARSE}), " if src else ""
    return f"""WITH {CUST}, {made}{", ".join(parts)}
SELECT c_custkey, round(coalesce(acctbal, k_acctbal.fill, (SELECT avg(acctbal) FROM cf)), 6) AS acctbal,
  round(coalesce(price, k_price.fill, (SELECT avg(price) FROM cf)), 6) AS price{extra}
FROM {src or 'cf'} LEFT JOIN k_acctbal ON c_custkey = k_acctbal.rk LEFT JOIN k_price ON c_custkey = k_price.rk"""


@register("t1_impute_median", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM li)) AS l_quantity, round(coalesce(l_discount, (SELECT median(l_discount) FROM li)), 6) AS l_discount FROM li")
def t1(spark, sf):
    return rounded(I.impute(li_null(spark, sf), ["l_quantity", "l_discount"], "median").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


@register("t1_impute_mean", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM li)), 6) AS l_quantity FROM li")
def t1b(spark, sf):
    return rounded(I.impute(li_null(spark, sf), ["l_quantity"], "mean").select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t1_impute_mode", f"""WITH {LI_NULL} SELECT l_orderkey, l_linenumber, coalesce(l_quantity,
  (SELECT l_quantity FROM li WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_quantity LIMIT 1)) AS l_quantity FROM li""")
def t1c(spark, sf):
    return rounded(I.impute(li_null(spark, sf), ["l_quantity"], "mode").select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t2_impute_by_group", f"""WITH {LI_NULL} SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, median(l_quantity) OVER (PARTITION BY l_returnflag), (SELECT median(l_quantity) FROM li)), 6) AS l_quantity FROM li""")
def t2(spark, sf):
    return rounded(I.impute_by_group(li_null(spark, sf), "l_returnflag", ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t3_impute_knn", _knn_sql())
def t3(spark, sf):
    out = I.impute_knn(cust_features(spark, sf), "c_custkey", FEATS, ["acctbal", "price"], k=5)
    return rounded(out.select("c_custkey", "acctbal", "price"))


@register("t4_impute_by_group_knn", _knn_sql(group=True))
def t4(spark, sf):
    out = I.impute_by_group_knn(cust_features(spark, sf), "c_custkey", "c_mktsegment", FEATS, ["acctbal", "price"])
    return rounded(out.select("c_custkey", "acctbal", "price"))


#: two of three rows lack "sparse", so it is filled with its median before the others are filled by neighbours
SPARSE = """SELECT *, coalesce(CASE WHEN c_custkey % 3 = 0 THEN nation END, (SELECT median(nation) FROM cf WHERE c_custkey % 3 = 0)) AS sparse FROM cf"""


@register("t5_impute_auto", _knn_sql(feats=[*FEATS, "sparse"], src="cs", extra=", round(sparse, 6) AS sparse"))
def t5(spark, sf):
    f = cust_features(spark, sf).withColumn("sparse", F.when(F.col("c_custkey") % 3 == 0, F.col("nation")))
    return rounded(I.impute_auto(f, "c_custkey", ["acctbal", "price", "sparse"], FEATS + ["sparse"])
                   .select("c_custkey", "acctbal", "price", "sparse"))


@register("t6_impute_iterative")
def t6(spark, sf):
    f = cust_features(spark, sf)
    return rounded(I.impute_iterative(f, ["acctbal", "n_orders", "price"], rounds=10).select("c_custkey", "acctbal", "price"))


def _z(col, sd="stddev_samp", src="lineitem"):
    return f"({col} - (SELECT avg({col}) FROM {src})) / nullif((SELECT {sd}({col}) FROM {src}), 0)"


@register("t7_scale_standard", f"SELECT l_orderkey, l_linenumber, round({_z('l_quantity', 'stddev_pop')}, 6) AS l_quantity_scaled, round({_z('l_tax', 'stddev_pop')}, 6) AS l_tax_scaled FROM lineitem")
def t7(spark, sf):
    return rounded(S.scale_standard(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"]).select(
        "l_orderkey", "l_linenumber", "l_quantity_scaled", "l_tax_scaled"))


@register("t8_zscore", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, round({_z('l_quantity', src='li')}, 6) AS l_quantity_zscore FROM li")
def t8(spark, sf):
    return rounded(S.zscore(li_null(spark, sf), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity_zscore"))


@register("t9_scale_minmax", """SELECT l_orderkey, l_linenumber, round((l_discount - (SELECT min(l_discount) FROM lineitem)) / ((SELECT max(l_discount) - min(l_discount) FROM lineitem) + 1e-6), 6) AS l_discount_minmax,
  round((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / nullif((SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 0), 6) AS l_quantity_minmax FROM lineitem""")
def t9(spark, sf):
    li = table(spark, sf, "lineitem")
    a = S.scale_minmax(li, ["l_discount"], eps=1e-6)
    b = S.scale_minmax(a, ["l_quantity"])
    return rounded(b.select("l_orderkey", "l_linenumber", "l_discount_minmax", "l_quantity_minmax"))


@register("t10_scale_robust", """SELECT event_id, round((value - (SELECT median(value) FROM events)) / coalesce(nullif((SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events), 0), 1), 6) AS value_scaled FROM events""")
def t10(spark, sf):
    return rounded(S.scale_robust(table(spark, sf, "events"), ["value"]).select("event_id", "value_scaled"))


@register("t11_normal_flag", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(coalesce(abs({_z('l_quantity', 'stddev_pop', 'li')}) <= 2, false) AS INTEGER) AS l_quantity_normal FROM li")
def t11(spark, sf):
    return S.normal_flag(li_null(spark, sf), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity_normal")


@register("t12_winsorize_quantile", """SELECT event_id, round(least(greatest(value, (SELECT quantile_cont(value, 0.05) FROM events)), (SELECT quantile_cont(value, 0.95) FROM events)), 6) AS value FROM events""")
def t12(spark, sf):
    return rounded(S.winsorize_quantile(table(spark, sf, "events"), ["value"]).select("event_id", "value"))


@register("t13_winsorize_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, quantile_cont(value, 0.05) p5, quantile_cont(value, 0.95) p95 FROM events),
w AS (SELECT event_id, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN p5 WHEN value > q3 + 1.5 * (q3 - q1) THEN p95 ELSE value END AS v FROM events, q)
SELECT event_id, round(v, 6) AS value_winsorized, round(ln(1 + v + 1e-10), 6) AS value_log FROM w""")
def t13(spark, sf):
    return rounded(S.winsorize_iqr(table(spark, sf, "events"), "value").select("event_id", "value_winsorized", "value_log"))


@register("t14_flag_iqr_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) a1, quantile_cont(value, 0.75) a3, quantile_cont(user_id, 0.25) b1, quantile_cont(user_id, 0.75) b3 FROM events)
SELECT event_id, CAST(value < a1 - 3 * (a3 - a1) OR value > a3 + 3 * (a3 - a1) AS INTEGER) AS value_outlier,
  CAST(user_id < b1 - 3 * (b3 - b1) OR user_id > b3 + 3 * (b3 - b1) AS INTEGER) AS user_id_outlier,
  CAST(value < a1 - 3 * (a3 - a1) OR value > a3 + 3 * (a3 - a1) AS INTEGER) + CAST(user_id < b1 - 3 * (b3 - b1) OR user_id > b3 + 3 * (b3 - b1) AS INTEGER) AS outlier_count FROM events, q""")
def t14(spark, sf):
    return S.flag_iqr_outliers(table(spark, sf, "events"), ["value", "user_id"], k=3).select(
        "event_id", "value_outlier", "user_id_outlier", "outlier_count")


@register("t15_flag_sd_anomalies", """WITH s AS (SELECT avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_discount) md, stddev_samp(l_discount) sd FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity > mq + 2 * sq AS INTEGER) AS anomalous_l_quantity, CAST(l_discount < md - 2 * sd AS INTEGER) AS anomalous_l_discount FROM lineitem, s)
SELECT *, greatest(anomalous_l_quantity, anomalous_l_discount) AS any_anomaly,
  CAST(sum(greatest(anomalous_l_quantity, anomalous_l_discount)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total_anomalies FROM f""")
def t15(spark, sf):
    out = S.flag_sd_anomalies(table(spark, sf, "lineitem"), "l_orderkey", high=["l_quantity"], low=["l_discount"])
    return out.select("l_orderkey", "l_linenumber", "anomalous_l_quantity", "anomalous_l_discount", "any_anomaly",
                      F.col("total_anomalies").cast("long").alias("total_anomalies"))


@register("t16_log_if_skewed", """SELECT event_id, round(ln(1 + value), 6) AS value_log FROM events""")
def t16(spark, sf):
    # value: min > 0 and |skew| > 1 -> transformed; user_id has min 0 -> kept as is
    out, chosen = S.log_if_skewed(table(spark, sf, "events"), ["value", "user_id"], threshold=1.0)
    return rounded(out.select("event_id", *[f"{c}_log" for c in chosen]))


@register("t17_flag_quantile", """SELECT event_id, CAST(value <= (SELECT quantile_cont(value, 0.25) FROM events) AS INTEGER) AS value_low_q25,
  CAST(value >= (SELECT quantile_cont(value, 0.8) FROM events) AS INTEGER) AS value_high_q80 FROM events""")
def t17(spark, sf):
    e = S.flag_quantile(table(spark, sf, "events"), "value", 0.25, "low")
    e = S.flag_quantile(e, "value", 0.8, "high")
    return e.select("event_id", "value_low_q25", "value_high_q80")


@register("t18_label_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_code FROM orders")
def t18(spark, sf):
    return S.label_encode(table(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority_code")
