"""Sources and sinks S1-S5 on the benchmark tables (one path is absent on
purpose to exercise the missing-table report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.quality import profile_columns
from ..sources import io as S
from .registry import register, rounded, table


def _paths(sf):
    base = sf.rstrip("/")
    return {"customer": f"{base}/customer.parquet", "orders": f"{base}/orders.parquet",
            "events": f"{base}/events.parquet", "imaging": f"{base}/not_shipped.parquet"}


@register("s1_load_modalities", """SELECT * FROM (VALUES ('customer', 'loaded', (SELECT count(*) FROM customer)), ('orders', 'loaded', (SELECT count(*) FROM orders)),
  ('events', 'loaded', (SELECT count(*) FROM events)), ('imaging', 'missing', NULL)) t("table", status, n_rows)""")
def s1(spark, sf):
    tables, report = S.load_modalities(spark, _paths(sf))
    counts = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    return report.join(counts, "table", "left").select("table", "status", "n_rows")


@register("s2_write_table", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def s2(spark, sf):
    agg = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                                                   F.round(F.sum("o_totalprice"), 2).alias("total"))
    path = S.write_table(agg, S.output_path(spark, "s2"), "parquet", partition_by=["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderpriority", "n", "total")


@register("s3_write_metadata")
def s3(spark, sf):
    stats = rounded(profile_columns(table(spark, sf, "customer")))
    path = S.write_metadata(stats, S.output_path(spark, "s3"), ["load", "profile"])
    return spark.read.json(path)


@register("s4_sample_n")
def s4(spark, sf):
    return S.sample_n(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 100,
                      ["l_orderkey", "l_linenumber"])


@register("s5_verify_inventory", """SELECT * FROM (VALUES ('customer', 'ok', (SELECT count(*) FROM customer), 5, (SELECT count(DISTINCT c_custkey) FROM customer)),
  ('orders', 'ok', (SELECT count(*) FROM orders), 6, (SELECT count(DISTINCT o_custkey) FROM orders)),
  ('events', 'ok', (SELECT count(*) FROM events), 6, (SELECT count(DISTINCT user_id) FROM events)),
  ('imaging', 'missing', NULL, NULL, NULL)) t("table", status, rows, columns, subjects)""")
def s5(spark, sf):
    return S.verify_inventory(spark, _paths(sf), {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"})
