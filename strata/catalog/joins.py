"""Join operators J1-J14.

Matching binding (FIXTURES.md B): subjects to match are ``supplier`` rows,
candidates ``customer`` rows; block = (nation key % 3, key % 2) as
(diagnosis, gender); age-like value = 50 + (acctbal + 1000) / 11000 * 60
(0..110 scale of the reference's ages), tolerance 2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..plans.integrate import Step, integrate
from .longitudinal import SCALE, visits
from .registry import quick_round, register, rounded, table


def demo_left(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("sid"), (F.col("s_nationkey") % 3).alias("dx"), (F.col("s_suppkey") % 2).alias("sex"),
                    (50 + (F.col("s_acctbal") + 1000) / 11000 * 60).alias("age"))


def demo_right(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("rid"), (F.col("c_nationkey") % 3).alias("r_dx"), (F.col("c_custkey") % 2).alias("r_sex"),
                    (50 + (F.col("c_acctbal") + 1000) / 11000 * 60).alias("r_age"))


DEMO = """l AS (SELECT s_suppkey AS sid, s_nationkey % 3 AS dx, s_suppkey % 2 AS sex, 50 + (s_acctbal + 1000) / 11000 * 60 AS age FROM supplier),
r AS (SELECT c_custkey AS rid, c_nationkey % 3 AS r_dx, c_custkey % 2 AS r_sex, 50 + (c_acctbal + 1000) / 11000 * 60 AS r_age FROM customer)"""


@register("j1_left_join_suffixed", """SELECT o_orderkey, o_custkey, o_totalprice AS acctbal, c_custkey, c_acctbal AS acctbal_src, c_mktsegment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("acctbal"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    return rounded(J.left_join_suffixed(o, c, "o_custkey", "c_custkey"))


@register("j2_outer_join_suffixed", """WITH a AS (SELECT o_custkey AS subject, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT user_id AS subject, count(*) AS n FROM events GROUP BY 1)
SELECT coalesce(a.subject, b.subject) AS subject, a.n AS n_x, b.n AS n_y FROM a FULL JOIN b ON a.subject = b.subject""")
def j2(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return J.outer_join_suffixed(a, b, "subject")


@register("j3_inner_join_keys", """WITH g AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS total_qty FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_qty FROM lineitem JOIN g USING (l_partkey, l_suppkey)""")
def j3(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("total_qty"))
    return rounded(J.inner_join_keys(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), g, ["l_partkey", "l_suppkey"]))


@register("j4_attach_lookup", """SELECT o_custkey AS subject, o_orderkey AS visit_id, d.diagnosis FROM orders
LEFT JOIN (SELECT o_custkey AS subject, o_orderkey AS visit_id, o_orderstatus AS diagnosis FROM orders WHERE o_orderkey % 3 <> 0) d
ON o_custkey = d.subject AND o_orderkey = d.visit_id""")
def j4(spark, sf):
    v = visits(spark, sf).select("subject", "visit_id")
    o = table(spark, sf, "orders")
    dx = o.where(F.col("o_orderkey") % 3 != 0).select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("visit_id"),
                                                       F.col("o_orderstatus").alias("diagnosis"))
    return J.attach_lookup(v, dx, ["subject", "visit_id"], ["diagnosis"])


@register("j5_attach_group_stat", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS value_mean FROM events")
def j5(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(J.attach_group_stat(e, "user_id", "value").select("event_id", "value_mean"))


@register("j6_outer_align", """WITH a AS (SELECT o_custkey AS subject, count(*) AS n_orders FROM orders GROUP BY 1),
b AS (SELECT user_id AS subject, count(*) AS n_events FROM events GROUP BY 1),
c AS (SELECT c_custkey AS subject, c_acctbal AS acctbal FROM customer)
SELECT coalesce(a.subject, b.subject, c.subject) AS subject, n_orders, n_events, acctbal
FROM a FULL JOIN b ON a.subject = b.subject FULL JOIN c ON coalesce(a.subject, b.subject) = c.subject""")
def j6(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf, "events").groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).alias("n_events"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("acctbal"))
    return rounded(J.outer_align([a, b, c], "subject"))


@register("j7_tolerance_join", f"""WITH {DEMO}
SELECT sid, rid, round(abs(age - r_age), 6) AS diff FROM l JOIN r ON dx = r_dx AND sex = r_sex AND abs(age - r_age) <= 2""")
def j7(spark, sf):
    j = J.tolerance_join(demo_left(spark, sf), demo_right(spark, sf), [("dx", "r_dx"), ("sex", "r_sex")], "age", "r_age", 2.0)
    return j.select("sid", "rid", quick_round(F.col("diff")).alias("diff"))


@register("j8_nearest_match", f"""WITH {DEMO}, c AS (SELECT sid, rid, abs(age - r_age) AS diff,
  row_number() OVER (PARTITION BY sid ORDER BY abs(age - r_age), rid) AS rn FROM l JOIN r ON dx = r_dx AND sex = r_sex AND abs(age - r_age) <= 2)
SELECT sid, rid AS match_rid, round(diff, 6) AS diff FROM c WHERE rn = 1""")
def j8(spark, sf):
    m = J.nearest_match(demo_left(spark, sf), demo_right(spark, sf), [("dx", "r_dx"), ("sex", "r_sex")],
                        "sid", "age", "rid", "r_age", 2.0)
    return rounded(m)


@register("j9_greedy_match")
def j9(spark, sf):
    return rounded(J.greedy_match(demo_left(spark, sf), demo_right(spark, sf), [("dx", "r_dx"), ("sex", "r_sex")],
                                  "sid", "sid", "age", "rid", "r_age", 2.0))


def _integration(spark, sf, explain=False):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), "c_nationkey", "c_acctbal")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.count(F.lit(1)).alias("n_visits"), F.avg(F.col("o_totalprice") / SCALE).alias("score"))
    events = table(spark, sf, "events").select(F.col("user_id").alias("subject"), "value", "event_id", "ts")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    steps = [Step("visits", orders, "subject"),
             Step("activity", events, "subject", collapse="first", order=["ts", "event_id"]),
             Step("nation", nation, "c_nationkey", "n_nationkey")]
    return integrate(base, steps, explain=explain)


@register("j10_integrate", """WITH o AS (SELECT o_custkey AS subject, count(*) AS n_visits, avg(o_totalprice / 654321.0) AS score FROM orders GROUP BY 1),
e AS (SELECT user_id AS subject, arg_min(value, (epoch_us(ts), event_id)) AS value, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id,
  min(ts) AS ts FROM events GROUP BY 1)
SELECT c_custkey AS subject, c_nationkey, c_acctbal, n_visits, round(score, 6) AS score, round(e.value, 6) AS value, e.event_id, e.ts,
  n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN o ON c_custkey = o.subject LEFT JOIN e ON c_custkey = e.subject
LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j10(spark, sf):
    wide, _ = _integration(spark, sf)
    return rounded(wide)


@register("j11_integration_log", """SELECT * FROM (VALUES ('visits', (SELECT count(*) FROM customer), 3, (SELECT count(*) FROM customer), 5),
 ('activity', (SELECT count(*) FROM customer), 5, (SELECT count(*) FROM customer), 8),
 ('nation', (SELECT count(*) FROM customer), 8, (SELECT count(*) FROM customer), 11)) t(step, rows_before, cols_before, rows_after, cols_after)""")
def j11(spark, sf):
    _, log = _integration(spark, sf, explain=True)
    return log


SOURCES_SQL = """s AS (SELECT DISTINCT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS k FROM customer
  UNION ALL SELECT DISTINCT 'orders', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT DISTINCT 'events', CAST(user_id AS VARCHAR) FROM events)"""


def _sources(spark, sf):
    return {"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("subject")),
            "orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("subject")),
            "events": table(spark, sf, "events").select(F.col("user_id").alias("subject"))}


@register("j12_key_overlap", f"""WITH {SOURCES_SQL}
SELECT a.source AS source_a, b.source AS source_b, count(*) AS n_common FROM s a JOIN s b ON a.k = b.k GROUP BY 1, 2""")
def j12(spark, sf):
    return J.key_overlap(_sources(spark, sf), "subject")


@register("j13_join_order", f"""WITH {SOURCES_SQL}, g AS (SELECT source, count(DISTINCT k) AS n_subjects FROM s GROUP BY 1)
SELECT source, n_subjects, CAST(row_number() OVER (ORDER BY n_subjects DESC, source) AS INTEGER) AS rank FROM g""")
def j13(spark, sf):
    return J.join_order(_sources(spark, sf), "subject")


@register("j14_map_values_dict", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS o_orderstatus_mapped FROM orders""")
def j14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return J.map_values(o, "o_orderstatus", {"F": "finished", "O": "open"}).select("o_orderkey", "o_orderstatus_mapped")


@register("j14_map_values_table", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j14b(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return J.map_values(c, "c_nationkey", table(spark, sf, "nation"), "nation", "n_nationkey", "n_name").select("c_custkey", "nation")
