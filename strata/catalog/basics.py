"""Selection (P*), sort / split (L*), set (U*) and scalar (F*) operators.

Bindings (FIXTURES.md B): ``lineitem`` is the measurement panel, ``customer``
the subject table, ``part`` the genotype-like text, ``events`` the daily
records.  Nulls are injected by fixed modulo rules written identically in
the Spark code and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as P
from .registry import register, rounded, table

LI_NULL = """li AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_linenumber = 1 THEN l_tax END AS l_tax, l_extendedprice, l_returnflag FROM lineitem)"""


def li_null(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
                     F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("l_tax"),
                     "l_extendedprice", "l_returnflag")


# -- P ------------------------------------------------------------------------

@register("p1_select_existing", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def p1(spark, sf):
    return P.select_existing(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "absent_col", "l_tax"])


@register("p2_select_like", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p2(spark, sf):
    return P.select_like(table(spark, sf, "customer"), ["NATION", "acct", "name"], numeric_only=True, keep=["c_custkey"])


@register("p3_split_by_modality", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem")
def p3(spark, sf):
    parts = P.split_by_modality(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                                [("price", ["price", "discount", "tax"]), ("amount", ["quantity"])])
    return parts["price"]


@register("p4_drop_sparse_columns", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice, l_returnflag FROM li")
def p4(spark, sf):
    return P.drop_sparse_columns(li_null(spark, sf), 0.5)


@register("p5_drop_empty_columns", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def p5(spark, sf):
    s = table(spark, sf, "supplier").withColumn("empty", F.lit(None).cast("double"))
    return P.drop_empty_columns(s)


@register("p6_drop_matching", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def p6(spark, sf):
    return P.drop_matching(table(spark, sf, "lineitem"), suffixes=["price", "_tax"], cols=["not_there"])


@register("p7_dropna_any", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber FROM li WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def p7(spark, sf):
    return P.dropna_subset(li_null(spark, sf), ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber")


@register("p7_dropna_all", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber FROM li WHERE l_quantity IS NOT NULL OR l_discount IS NOT NULL")
def p7b(spark, sf):
    return P.dropna_subset(li_null(spark, sf), ["l_quantity", "l_discount"], "all").select("l_orderkey", "l_linenumber")


@register("p8_keep_plausible_rows", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber FROM li WHERE l_quantity IS NULL OR (l_quantity > 0 AND l_quantity < 40)")
def p8(spark, sf):
    return P.keep_plausible_rows(li_null(spark, sf), "l_quantity", 0, 40).select("l_orderkey", "l_linenumber")


@register("p9_null_out_of_range", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_acctbal END AS c_acctbal FROM customer")
def p9(spark, sf):
    return rounded(P.null_out_of_range(table(spark, sf, "customer"), "c_acctbal", 0, 5000).select("c_custkey", "c_acctbal"))


@register("p10_null_sentinels", "SELECT p_partkey, CASE WHEN p_size NOT IN (1, 50) THEN p_size END AS p_size FROM part")
def p10(spark, sf):
    return P.null_sentinels(table(spark, sf, "part"), "p_size", [1, 50]).select("p_partkey", "p_size")


@register("p11_null_infinite", """SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events""")
def p11(spark, sf):
    e = table(spark, sf, "events")
    v = (F.when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
         .when(F.col("event_id") % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    return rounded(P.null_infinite(e.select("event_id", v.alias("value")), ["value"]))


@register("p12_prefix_columns", "SELECT s_suppkey, s_name AS src_s_name, s_nationkey AS src_s_nationkey, s_acctbal AS src_s_acctbal FROM supplier")
def p12(spark, sf):
    return P.prefix_columns(table(spark, sf, "supplier"), "src_", keep=["s_suppkey"])


@register("p13_rule_flag_and", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(coalesce(l_quantity > 25 AND l_discount < 0.05, false) AS INTEGER) AS rule_flag FROM li")
def p13(spark, sf):
    return P.rule_flag(li_null(spark, sf), ["l_quantity > 25", "l_discount < 0.05"]).select("l_orderkey", "l_linenumber", "rule_flag")


@register("p13_rule_flag_or", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, CAST(coalesce(l_quantity > 25 OR l_discount < 0.05, false) AS INTEGER) AS rule_flag FROM li")
def p13b(spark, sf):
    return P.rule_flag(li_null(spark, sf), ["l_quantity > 25", "l_discount < 0.05"], "or").select("l_orderkey", "l_linenumber", "rule_flag")


# -- L ------------------------------------------------------------------------

@register("l1_sort_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC")
def l1(spark, sf):
    return P.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                       ["o_orderpriority", "o_totalprice"], [True, False])


@register("l2_top_categories", "SELECT p_type, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, p_type LIMIT 3")
def l2(spark, sf):
    return P.top_categories(table(spark, sf, "part"), "p_type", 3)


@register("l4_split_random")
def l4(spark, sf):
    return P.split_random(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@register("l5_split_stratified")
def l5(spark, sf):
    return P.split_stratified(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"),
                              ["l_orderkey", "l_linenumber"], "l_returnflag")


@register("l6_split_time_ordered", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) AS INTEGER) AS is_train FROM orders""")
def l6(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return P.split_time_ordered(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_train")


@register("l6_time_series_folds", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no, count(*) OVER () AS n FROM orders),
f AS (SELECT * FROM range(5) t(fold))
SELECT o_orderkey, row_no, CAST(fold AS INTEGER) AS fold,
  CASE WHEN row_no <= n - (5 - fold) * (n // 6) THEN 'train' ELSE 'validate' END AS role
FROM r, f WHERE row_no <= n - (5 - fold) * (n // 6) + n // 6""")
def l6b(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return P.time_series_folds(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_no", "fold", "role")


@register("l7_sample_stratified")
def l7(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.sample_stratified(li, ["l_orderkey", "l_linenumber"], "l_returnflag", 1000)


@register("l8_keep_frequent", """SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 60)""")
def l8(spark, sf):
    return P.keep_frequent(table(spark, sf, "customer"), "c_nationkey", 60).select("c_custkey")


# -- U ------------------------------------------------------------------------

@register("u1_union_tables", """SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment, NULL AS s_name FROM customer
UNION ALL SELECT s_suppkey AS id, s_acctbal AS acctbal, NULL AS segment, s_name FROM supplier""")
def u1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
                                            F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"), "s_name")
    return rounded(P.union_tables([c, s]))


@register("u2_distinct_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def u2(spark, sf):
    return P.distinct_rows(table(spark, sf, "orders").select("o_custkey", "o_orderpriority"))


@register("u2_first_per_subset", """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER
 (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def u2b(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return P.distinct_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@register("u3_keys_missing_from", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u3(spark, sf):
    return P.keys_missing_from(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@register("u4_coalesce_columns", f"WITH {LI_NULL} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, l_discount) AS l_quantity FROM li")
def u4(spark, sf):
    return rounded(P.coalesce_columns(li_null(spark, sf), "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "l_quantity"))
