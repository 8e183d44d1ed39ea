"""Aggregation operators A1-A17.

``events`` plays the daily-activity table (subject = ``user_id``; measures =
``value`` overall and per event type); ``lineitem`` the measurement panel;
``orders`` the visits; ``customer`` the subjects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg as A
from ..operators import windows as W
from .basics import LI_NULL, li_null
from .longitudinal import SCALE, VISITS, VISITS_NULL, t_pvalue_sql, visits
from .registry import register, rounded, table


def activity(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("subject_id"), "ts", "value",
                    F.when(F.col("event_type") == "click", F.col("value")).alias("click_value"),
                    F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"))


ACT = """act AS (SELECT user_id AS subject_id, ts, value, CASE WHEN event_type = 'click' THEN value END AS click_value,
  CASE WHEN event_type = 'purchase' THEN value END AS purchase_value FROM events)"""


def _prof_sql(cols, suffix=""):
    return ", ".join(f"round(avg({c}), 6) AS {c}_mean{suffix}, round(stddev_samp({c}), 6) AS {c}_std{suffix}, "
                     f"round(min({c}), 6) AS {c}_min{suffix}, round(max({c}), 6) AS {c}_max{suffix}" for c in cols)


@register("a1_agg_profile", f"WITH {ACT} SELECT subject_id, {_prof_sql(['value', 'click_value'])} FROM act GROUP BY subject_id")
def a1(spark, sf):
    return rounded(A.agg_profile(activity(spark, sf), ["subject_id"], ["value", "click_value"]))


@register("a2_agg_calendar_week", f"WITH {ACT} SELECT subject_id, CAST(weekofyear(ts) AS INTEGER) AS week, {_prof_sql(['value'], '_weekly')} FROM act GROUP BY subject_id, weekofyear(ts)")
def a2w(spark, sf):
    return rounded(A.agg_calendar(activity(spark, sf), "subject_id", "ts", "week", ["value"]))


@register("a2_agg_calendar_month", f"WITH {ACT} SELECT subject_id, CAST(month(ts) AS INTEGER) AS month, {_prof_sql(['value'], '_monthly')} FROM act GROUP BY subject_id, month(ts)")
def a2m(spark, sf):
    return rounded(A.agg_calendar(activity(spark, sf), "subject_id", "ts", "month", ["value"]))


@register("a3_weekday_weekend_variation", f"""WITH {ACT}, g AS (SELECT subject_id,
  avg(value) FILTER (WHERE isodow(ts) < 6) AS value_weekday, avg(value) FILTER (WHERE isodow(ts) >= 6) AS value_weekend,
  avg(click_value) FILTER (WHERE isodow(ts) < 6) AS click_value_weekday, avg(click_value) FILTER (WHERE isodow(ts) >= 6) AS click_value_weekend
  FROM act GROUP BY subject_id)
SELECT subject_id, round(value_weekday, 6) AS value_weekday, round(value_weekend, 6) AS value_weekend,
  round(click_value_weekday, 6) AS click_value_weekday, round(click_value_weekend, 6) AS click_value_weekend,
  round((value_weekend - value_weekday) / nullif(value_weekday, 0) * 100, 6) AS value_variation,
  round((click_value_weekend - click_value_weekday) / nullif(click_value_weekday, 0) * 100, 6) AS click_value_variation FROM g""")
def a3(spark, sf):
    return rounded(A.weekday_weekend_variation(activity(spark, sf), "subject_id", "ts", ["value", "click_value"]))


@register("a4_median_per_key", "SELECT l_suppkey, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def a4(spark, sf):
    return rounded(A.median_per_key(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"]))


ORD_NUM = "(date_diff('day', DATE '1970-01-01', visit_date) * 100000000 + visit_id)"


@register("a5_first_non_null", f"""WITH {VISITS_NULL}
SELECT subject, round(arg_min(score, {ORD_NUM}) FILTER (WHERE score IS NOT NULL), 6) AS score,
  CAST(arg_min(visit_date, {ORD_NUM}) AS VARCHAR) AS visit_date FROM visits GROUP BY subject""")
def a5(spark, sf):
    v = visits(spark, sf, with_nulls=True)
    return rounded(W.first_non_null(v.select("subject", "score", "visit_date", "visit_id"), "subject",
                                    ["visit_date", "visit_id"], ["score", "visit_date"]))


@register("a6_value_counts", "SELECT o_orderpriority, count(*) AS count, round(count(*) / (SELECT count(o_orderpriority) FROM orders)::DOUBLE, 6) AS proportion FROM orders GROUP BY o_orderpriority")
def a6(spark, sf):
    return rounded(A.value_counts(table(spark, sf, "orders"), "o_orderpriority"))


@register("a7_crosstab", """WITH b AS (SELECT l_returnflag, l_linestatus FROM lineitem),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS count FROM b GROUP BY l_returnflag, l_linestatus
  UNION ALL SELECT l_returnflag, 'All', count(*) FROM b GROUP BY l_returnflag
  UNION ALL SELECT 'All', l_linestatus, count(*) FROM b GROUP BY l_linestatus
  UNION ALL SELECT 'All', 'All', count(*) FROM b),
r AS (SELECT l_returnflag, count(*) AS n FROM b GROUP BY l_returnflag UNION ALL SELECT 'All', count(*) FROM b)
SELECT c.l_returnflag, c.l_linestatus, c.count, round(c.count / r.n, 6) AS share FROM c JOIN r USING (l_returnflag)""")
def a7(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.crosstab_long(li, "l_returnflag", "l_linestatus", normalize="index", margins=True))


@register("a8_pivot_count", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag""")
def a8(spark, sf):
    return A.pivot_count(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@register("a9_distinct_profile", """WITH p AS (SELECT o_custkey, count(*) AS r FROM orders GROUP BY o_custkey)
SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS o_custkey_distinct,
  (SELECT count(DISTINCT o_orderpriority) FROM orders) AS o_orderpriority_distinct,
  (SELECT count(DISTINCT o_orderstatus) FROM orders) AS o_orderstatus_distinct,
  round(avg(r), 6) AS records_per_subject_mean, max(r) AS records_per_subject_max FROM p""")
def a9(spark, sf):
    return rounded(A.distinct_profile(table(spark, sf, "orders"), "o_custkey", ["o_custkey", "o_orderpriority", "o_orderstatus"]))


@register("a10_stratum_profile", f"""SELECT o_orderpriority, round(avg(o_totalprice / {SCALE}), 3) AS mean, round(stddev_samp(o_totalprice / {SCALE}), 3) AS std,
  count(*) AS count, round(median(o_totalprice / {SCALE}), 3) AS median, round(min(o_totalprice / {SCALE}), 3) AS min, round(max(o_totalprice / {SCALE}), 3) AS max
FROM orders GROUP BY o_orderpriority""")
def a10(spark, sf):
    o = table(spark, sf, "orders").withColumn("score", F.col("o_totalprice") / SCALE)
    return A.stratum_profile(o, "o_orderpriority", "score")


CORR_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _corr_sql():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if i == j:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END AS corr FROM li")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM li")
    return f"WITH {LI_NULL} " + " UNION ALL ".join(parts)


@register("a11_corr_matrix", _corr_sql())
def a11(spark, sf):
    return rounded(A.corr_matrix(li_null(spark, sf), CORR_COLS))


@register("a12_corr_with_target", f"""WITH {LI_NULL}, c AS (
  SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS corr, count(*) FILTER (WHERE l_quantity IS NOT NULL) AS n_obs FROM li
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice), count(*) FILTER (WHERE l_discount IS NOT NULL) FROM li
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice), count(*) FILTER (WHERE l_tax IS NOT NULL) FROM li)
SELECT feature, round(corr, 6) AS corr, n_obs, round(abs(corr), 6) AS abs_corr FROM c WHERE n_obs > 10 AND corr IS NOT NULL""")
def a12(spark, sf):
    return rounded(A.corr_with_target(li_null(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@register("a13_corr_pairs", f"""WITH {LI_NULL}, c AS (
  SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr FROM li
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM li
  UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM li
  UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM li
  UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM li
  UNION ALL SELECT 'l_tax', 'l_extendedprice', corr(l_tax, l_extendedprice) FROM li)
SELECT a, b, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.5""")
def a13(spark, sf):
    return rounded(A.corr_pairs(li_null(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 0.5))


WELCH = """s AS (SELECT count(*) FILTER (WHERE c_custkey % 2 = 0) AS n_a, avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) AS mean_a,
  var_samp(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) AS var_a, count(*) FILTER (WHERE c_custkey % 2 = 1) AS n_b,
  avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) AS mean_b, var_samp(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) AS var_b FROM customer),
w AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
  power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS nu FROM s)"""
WELCH_OUT = "n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(t, 6) AS t_stat, round(nu, 6) AS dof"


@register("a14_welch_t", f"WITH {WELCH} SELECT {WELCH_OUT} FROM w")
def a14(spark, sf):
    c = table(spark, sf, "customer").withColumn("g", F.col("c_custkey") % 2)
    return rounded(A.welch_t(c, "g", "c_acctbal", 0, 1).drop("p_value"))


@register("a14_welch_p", f"WITH {WELCH} SELECT {WELCH_OUT}, round({t_pvalue_sql('t', 'nu')}, 6) AS p_value FROM w")
def a14p(spark, sf):
    c = table(spark, sf, "customer").withColumn("g", F.col("c_custkey") % 2)
    return rounded(A.welch_t(c, "g", "c_acctbal", 0, 1))


@register("a15_time_bin_profile", f"""WITH {VISITS}, g AS (SELECT floor(t_months / 6) * 6 AS time_bin, avg(score) AS mean, stddev_samp(score) AS std, count(score) AS count FROM visits GROUP BY 1)
SELECT CAST(time_bin AS DOUBLE) AS time_bin, round(mean, 6) AS mean, round(std, 6) AS std, count,
  round(((SELECT mean FROM g ORDER BY time_bin DESC LIMIT 1) - (SELECT mean FROM g ORDER BY time_bin LIMIT 1)) / (SELECT count(*) FROM g), 6) AS mean_increase_per_bin FROM g""")
def a15(spark, sf):
    return rounded(A.time_bin_profile(visits(spark, sf), "t_months", "score"))


@register("a16_monthly_mean", "SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, round(avg(value), 6) AS mean, count(value) AS count FROM events GROUP BY 1")
def a16(spark, sf):
    return rounded(A.monthly_mean(table(spark, sf, "events"), "ts", "value"))


@register("a16_yearly_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1")
def a16y(spark, sf):
    return A.yearly_counts(table(spark, sf, "orders"), "o_orderdate")


@register("a17_trend_of_means", f"""WITH {VISITS}, m AS (SELECT ordinal, avg(score) AS m FROM visits GROUP BY ordinal)
SELECT round(regr_slope(m, ordinal), 6) AS slope, count(*) AS n_groups FROM m""")
def a17(spark, sf):
    return rounded(A.trend_of_means(visits(spark, sf), "ordinal", "score"))


@register("l3_top_features", f"""WITH {LI_NULL}, c AS (
  SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS corr FROM li
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM li
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM li
  UNION ALL SELECT 'l_partkey', corr(l_partkey, l_extendedprice) FROM li)
SELECT feature, round(corr, 6) AS corr FROM c ORDER BY abs(corr) DESC, feature LIMIT 2""")
def l3(spark, sf):
    from ..operators.select import top_features
    scores = A.corr_with_target(li_null(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_partkey"], "l_extendedprice")
    return rounded(top_features(scores.select("feature", "corr"), "corr", 2))
