"""Window (W*) and longitudinal (G*) operators bound to ``orders`` as visits.

Binding (FIXTURES.md B): subject = ``o_custkey``, visit date =
``o_orderdate`` (as date), visit id (tie-break) = ``o_orderkey``, score =
``o_totalprice / 654321`` (0..~0.85; a divisor with a prime factor other
than 2 and 5 keeps values off exact decimal rounding boundaries), ordinal = leading digit of ``o_orderpriority``,
time in months = days since 1992-01-01 / 30.  Null-handling operators get
nulls from the fixed rule ``o_orderkey % 7 = 0``, written identically in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import longitudinal as G
from ..operators import windows as W
from .registry import register, rounded, table

KEY, ORDER = "subject", ["visit_date", "visit_id"]
SCALE = 654321.0  # score = price / SCALE: 0..~0.85, never a terminating decimal


def visits(spark, sf, with_nulls: bool = False):
    o = table(spark, sf, "orders")
    score = F.col("o_totalprice") / SCALE
    if with_nulls:
        score = F.when(F.col("o_orderkey") % 7 != 0, score)
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("visit_id"),
                    F.to_date("o_orderdate").alias("visit_date"), score.alias("score"),
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("ordinal"),
                    (F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 30.0).alias("t_months"))


VISITS = f"""visits AS (SELECT o_custkey AS subject, o_orderkey AS visit_id,
  CAST(o_orderdate AS DATE) AS visit_date, o_totalprice / {SCALE} AS score,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ordinal,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30.0 AS t_months FROM orders)"""

VISITS_NULL = VISITS.replace(f"o_totalprice / {SCALE} AS score",
                             f"CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / {SCALE} END AS score")

WIN = "PARTITION BY subject ORDER BY visit_date, visit_id"


# -- entry: G1 -> G5 -> A6 ---------------------------------------------------

def progression_overview(spark, sf):
    v = visits(spark, sf)
    ch = G.annualised_change(v, KEY, ORDER, "visit_date", "score")
    per_subject = (G.progression_pattern(ch, KEY, ORDER, "score")
                   .join(ch.groupBy(KEY).agg(F.avg("score_change_annual_winsorized").alias("annual_w")), KEY))
    dist = (per_subject.groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("total_change").alias("mean_change"),
                 F.avg("annual_w").alias("mean_annual_change")))
    # at most three rows: the share's denominator is a window over them
    share = F.col("n_subjects") / F.sum("n_subjects").over(Window.partitionBy())
    return rounded(dist.select("pattern", "n_subjects", share.alias("share"), "mean_change", "mean_annual_change"))


PROGRESSION_SQL = f"""WITH {VISITS},
c AS (SELECT *, count(*) OVER (PARTITION BY subject) AS nv,
   score - lag(score) OVER ({WIN}) AS d,
   date_diff('day', lag(visit_date) OVER ({WIN}), visit_date) AS dd,
   row_number() OVER ({WIN}) AS rn_a,
   row_number() OVER (PARTITION BY subject ORDER BY visit_date DESC, visit_id DESC) AS rn_d FROM visits),
a AS (SELECT *, CASE WHEN nv > 1 THEN d * 365.25 / nullif(dd, 0) END AS annual FROM c),
q AS (SELECT quantile_cont(annual, 0.05) AS lo, quantile_cont(annual, 0.95) AS hi FROM a),
w AS (SELECT a.*, CASE WHEN annual IS NOT NULL THEN least(greatest(annual, lo), hi) END AS annual_w FROM a CROSS JOIN q),
s AS (SELECT subject, count(*) AS n, max(CASE WHEN rn_d = 1 THEN score END) - max(CASE WHEN rn_a = 1 THEN score END) AS total_change,
   avg(annual_w) AS annual_w FROM w GROUP BY subject HAVING count(*) >= 2),
p AS (SELECT *, CASE WHEN total_change > 0.1 THEN 'progressive' WHEN total_change < -0.1 THEN 'improving' ELSE 'stable' END AS pattern FROM s)
SELECT pattern, count(*) AS n_subjects, round(count(*) / (SELECT count(*) FROM p)::DOUBLE, 6) AS share,
  round(avg(total_change), 6) AS mean_change, round(avg(annual_w), 6) AS mean_annual_change
FROM p GROUP BY pattern"""

register("g5_progression_overview", PROGRESSION_SQL)(progression_overview)


# -- W1 / W2 / W3 ------------------------------------------------------------

@register("w1_lag_per_subject", f"""WITH {VISITS}
SELECT subject, visit_id, round(score, 6) AS score, round(lag(score) OVER ({WIN}), 6) AS prev_score,
  CAST(lag(visit_date) OVER ({WIN}) AS VARCHAR) AS prev_visit_date FROM visits""")
def w1(spark, sf):
    v = visits(spark, sf).select(KEY, "visit_id", "visit_date", "score")
    return rounded(W.lag_per_subject(v, KEY, ORDER, ["score", "visit_date"]).drop("visit_date"))


@register("w2_rate_of_change", f"""WITH {VISITS}
SELECT subject, visit_id, round((score - lag(score) OVER ({WIN})) / nullif(t_months - lag(t_months) OVER ({WIN}), 0), 6) AS rate_of_change
FROM visits""")
def w2(spark, sf):
    v = visits(spark, sf)
    return rounded(W.rate_of_change(v, KEY, ORDER, "t_months", "score").select(KEY, "visit_id", "rate_of_change"))


@register("w3_baseline_change", f"""WITH {VISITS},
b AS (SELECT *, count(*) OVER (PARTITION BY subject) AS nv,
  first_value(score) OVER ({WIN}) AS fs, first_value(visit_date) OVER ({WIN}) AS fd FROM visits)
SELECT subject, visit_id, round(CASE WHEN nv > 1 THEN fs END, 6) AS baseline_value,
  round(score - CASE WHEN nv > 1 THEN fs END, 6) AS change_from_baseline,
  CAST(CASE WHEN nv > 1 THEN date_diff('day', fd, visit_date) END AS INTEGER) AS days_since_baseline FROM b""")
def w3(spark, sf):
    v = visits(spark, sf)
    return rounded(W.baseline_change(v, KEY, ORDER, "score", "visit_date")
                   .select(KEY, "visit_id", "baseline_value", "change_from_baseline", "days_since_baseline"))


@register("w4_subject_extrema", f"""WITH {VISITS}
SELECT subject, visit_id, round(max(score) OVER (PARTITION BY subject), 6) AS max_value,
  round(min(score) OVER (PARTITION BY subject), 6) AS min_value,
  round(stddev_samp(score) OVER (PARTITION BY subject), 6) AS variability FROM visits""")
def w4(spark, sf):
    v = visits(spark, sf).select(KEY, "visit_id", "score")
    return rounded(W.subject_extrema(v, KEY, "score").drop("score"))


@register("w5_rolling_mean", f"""WITH {VISITS_NULL}
SELECT subject, visit_id, round(CASE WHEN count(score) OVER ({WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2
  THEN avg(score) OVER ({WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END, 6) AS score_rolling3 FROM visits""")
def w5(spark, sf):
    v = visits(spark, sf, with_nulls=True)
    return rounded(W.rolling_mean(v, KEY, ORDER, "score").select(KEY, "visit_id", "score_rolling3"))


@register("w6_rank_pct", f"""WITH {VISITS_NULL}
SELECT visit_id, round(CASE WHEN score IS NOT NULL THEN
  (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(score) OVER () END, 6) AS score_pct
FROM visits""")
def w6(spark, sf):
    v = visits(spark, sf, with_nulls=True).select("visit_id", "score")
    return rounded(W.rank_pct(v, "score").select("visit_id", "score_pct"))


ORD_NUM = "(date_diff('day', DATE '1970-01-01', visit_date) * 100000000 + visit_id)"


@register("w7_latest_per_subject", f"""WITH {VISITS_NULL}
SELECT subject, arg_max(visit_id, {ORD_NUM}) AS visit_id,
  round(arg_max(score, {ORD_NUM}) FILTER (WHERE score IS NOT NULL), 6) AS score,
  arg_max(ordinal, {ORD_NUM}) AS ordinal FROM visits GROUP BY subject""")
def w7(spark, sf):
    v = visits(spark, sf, with_nulls=True).select(KEY, "visit_id", "visit_date", "score", "ordinal")
    return rounded(W.first_non_null(v, KEY, ORDER, ["visit_id", "score", "ordinal"], latest=True))


@register("w8_last_visit", f"""WITH {VISITS}
SELECT subject, visit_id, CAST(visit_date AS VARCHAR) AS visit_date, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date DESC, visit_id DESC) AS rn FROM visits) WHERE rn = 1""")
def w8(spark, sf):
    v = visits(spark, sf).select(KEY, "visit_id", "visit_date", "score")
    return rounded(W.last_visit(v, KEY, ORDER))


@register("w9_fill_group_median", f"""WITH {VISITS_NULL}
SELECT visit_id, round(coalesce(score, median(score) OVER (PARTITION BY subject)), 6) AS score FROM visits""")
def w9(spark, sf):
    v = visits(spark, sf, with_nulls=True).select(KEY, "visit_id", "score")
    return rounded(W.fill_group_median(v, KEY, "score").select("visit_id", "score"))


@register("w10_flag_duplicates", """SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 AS INTEGER) AS is_duplicate FROM orders""")
def w10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return W.flag_duplicates(o, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "is_duplicate")


@register("w11_half_index", f"""WITH {VISITS}
SELECT visit_id, CAST(row_number() OVER ({WIN}) AS INTEGER) AS _pos,
  CAST(row_number() OVER ({WIN}) > floor(count(*) OVER (PARTITION BY subject) / 2) AS INTEGER) AS half FROM visits""")
def w11(spark, sf):
    v = visits(spark, sf)
    return W.half_index(v, KEY, ORDER).select("visit_id", "_pos", "half")


# -- G1 .. G11 -----------------------------------------------------------------

@register("g1_annualised_change", f"""WITH {VISITS},
c AS (SELECT *, count(*) OVER (PARTITION BY subject) AS nv, score - lag(score) OVER ({WIN}) AS d,
  date_diff('day', lag(visit_date) OVER ({WIN}), visit_date) AS dd,
  date_diff('day', first_value(visit_date) OVER ({WIN}), visit_date) AS dsb FROM visits),
a AS (SELECT visit_id, CAST(CASE WHEN nv > 1 THEN dsb END AS INTEGER) AS days_since_baseline, CASE WHEN nv > 1 THEN d END AS ch,
  CASE WHEN nv > 1 THEN d * 365.25 / nullif(dd, 0) END AS an FROM c),
q AS (SELECT quantile_cont(ch, 0.05) a1, quantile_cont(ch, 0.95) a2, quantile_cont(an, 0.05) b1, quantile_cont(an, 0.95) b2 FROM a)
SELECT visit_id, days_since_baseline, round(ch, 6) AS score_change, round(an, 6) AS score_change_annual,
  round(CASE WHEN ch IS NOT NULL THEN least(greatest(ch, a1), a2) END, 6) AS score_change_winsorized,
  round(CASE WHEN an IS NOT NULL THEN least(greatest(an, b1), b2) END, 6) AS score_change_annual_winsorized
FROM a CROSS JOIN q""")
def g1(spark, sf):
    v = visits(spark, sf)
    out = G.annualised_change(v, KEY, ORDER, "visit_date", "score")
    return rounded(out.select("visit_id", "days_since_baseline", "score_change", "score_change_annual",
                              "score_change_winsorized", "score_change_annual_winsorized"))


@register("g2_transitions", f"""WITH {VISITS}
SELECT visit_id, lag(ordinal) OVER ({WIN}) AS diagnosis_prev, ordinal - lag(ordinal) OVER ({WIN}) AS diagnosis_transition,
  CAST(CASE WHEN lag(ordinal) OVER ({WIN}) IS NOT NULL THEN date_diff('day', lag(visit_date) OVER ({WIN}), visit_date) END AS INTEGER) AS days_to_transition
FROM visits""")
def g2(spark, sf):
    v = visits(spark, sf)
    return G.transitions(v, KEY, ORDER, "visit_date", "ordinal").select(
        "visit_id", "diagnosis_prev", "diagnosis_transition", "days_to_transition")


@register("g3_subject_slope", f"""WITH {VISITS}
SELECT visit_id, round(CASE WHEN count(*) OVER (PARTITION BY subject) >= 3
  THEN regr_slope(score, t_months) OVER (PARTITION BY subject) END, 6) AS overall_slope FROM visits""")
def g3(spark, sf):
    v = visits(spark, sf)
    return rounded(G.subject_slope(v, KEY, "t_months", "score").select("visit_id", "overall_slope"))


def t_pvalue_sql(t: str, nu: str) -> str:
    """Two-sided Student-t tail of the columns t and nu (doubles) in DuckDB SQL:
    the incomplete beta function's continued fraction, 600 levels from the last
    one up, on the side on which it converges."""
    def side(a: str, b: str, x: str) -> str:
        i = "floor(m / 2)"
        fraction = (f"list_reduce(list_transform(range(600, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda y, m: "
                    f"CASE WHEN m % 2 = 1 THEN -({a} + {i}) * ({a} + {b} + {i}) * {x} ELSE {i} * ({b} - {i}) * {x} END "
                    f"/ (({a} + m - 1) * ({a} + m)) / (1.0 + y), CAST(0 AS DOUBLE))")
        return (f"exp(-{nu} / 2 * ln(1 + {t} * {t} / {nu}) + 0.5 * ln({t} * {t} / ({nu} + {t} * {t})) "
                f"- (lgamma({nu} / 2) + lgamma(0.5) - lgamma({nu} / 2 + 0.5))) / ({a}) / (1.0 + {fraction})")

    x, rest = f"({nu} / ({nu} + {t} * {t}))", f"({t} * {t} / ({nu} + {t} * {t}))"
    return (f"CASE WHEN NOT {nu} > 0 THEN NULL WHEN {t} = 0 THEN 1.0 WHEN {x} < ({nu} / 2 + 1) / ({nu} / 2 + 2.5) "
            f"THEN {side(f'{nu} / 2', '0.5', x)} ELSE 1.0 - {side('0.5', f'{nu} / 2', rest)} END")


TREND_SUMS = f"""WITH {VISITS},
h AS (SELECT subject, t_months - avg(t_months) OVER (PARTITION BY subject) AS t, score AS y,
  CAST(row_number() OVER ({WIN}) > floor(count(*) OVER (PARTITION BY subject) / 2) AS INTEGER) AS hf FROM visits),
g AS (SELECT subject, count(*) AS n, count(DISTINCT t) AS nt, regr_slope(y, t) AS slope,
  CASE WHEN var_pop(y) = 0 THEN 0.0 ELSE corr(y, t) END AS r,
  count(y) FILTER (WHERE hf = 0) AS n1, count(y) FILTER (WHERE hf = 1) AS n2,
  avg(y) FILTER (WHERE hf = 0) AS m1, avg(y) FILTER (WHERE hf = 1) AS m2,
  var_samp(y) FILTER (WHERE hf = 0) AS v1, var_samp(y) FILTER (WHERE hf = 1) AS v2,
  count(*)::DOUBLE AS s0, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4,
  sum(y) AS sy, sum(t*y) AS sty, sum(t*t*y) AS st2y FROM h GROUP BY subject)"""

T_SLOPE, T_HALF = (
    "r * sqrt((n - 2) / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20)))",
    "(m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0)")
CURVATURE = """CASE WHEN nt >= 3 THEN 100.0 * (s0 * (s2 * st2y - sty * s3) - s1 * (s1 * st2y - sty * s2) + sy * (s1 * s3 - s2 * s2))
   / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0) END"""

TREND_SQL = f"""{TREND_SUMS}
SELECT subject, n, round(slope, 6) AS slope, round({T_SLOPE}, 6) AS t_slope, round({T_HALF}, 6) AS t_half, round({CURVATURE}, 4) AS curvature FROM g"""

TREND_CLASS_SQL = f"""{TREND_SUMS},
t AS (SELECT *, CASE WHEN n >= 3 THEN {T_SLOPE} END AS ts, CAST(n - 2 AS DOUBLE) AS us,
  CASE WHEN n1 > 1 AND n2 > 1 THEN {T_HALF} END AS th, CAST(n1 + n2 - 2 AS DOUBLE) AS uh, {CURVATURE} AS curvature FROM g),
p AS (SELECT *, {t_pvalue_sql("ts", "us")} AS p_value, {t_pvalue_sql("th", "uh")} AS p_half FROM t)
SELECT subject, n, round(slope, 6) AS slope, round(p_value, 6) AS p_value, round(th, 6) AS t_half, round(p_half, 6) AS p_half, round(curvature, 4) AS curvature,
  CASE WHEN n < 3 THEN 'insufficient_data' WHEN nt = 1 THEN 'constant_time'
   WHEN p_value < 0.05 THEN CASE WHEN slope > 0.03 THEN 'progressive' WHEN slope < -0.03 THEN 'improving' ELSE 'stable' END
   WHEN p_half < 0.1 THEN CASE WHEN m2 - m1 > 0.05 THEN 'progressive' WHEN m2 - m1 < -0.05 THEN 'improving' ELSE 'stable' END
   WHEN abs(curvature) > 0.5 THEN 'nonlinear' ELSE 'stable' END AS pattern FROM p"""


@register("g4_trend_moments", TREND_SQL)
def g4m(spark, sf):
    v = visits(spark, sf)
    m = G.trend_moments(v, KEY, ORDER, "t_months", "score")
    return rounded(m.select(KEY, "n", "slope", "t_slope", "t_half", F.round("curvature", 4).alias("curvature")))


@register("g4_trend_class", TREND_CLASS_SQL)
def g4c(spark, sf):
    v = visits(spark, sf)
    out = G.classify_trend(v, KEY, ORDER, "t_months", "score")
    # the parabola's coefficient to 4 places, as its sums cancel
    return rounded(out.withColumn("curvature", F.round("curvature", 4)))


@register("g5_progression_pattern", f"""WITH {VISITS},
r AS (SELECT *, row_number() OVER ({WIN}) AS a, row_number() OVER (PARTITION BY subject ORDER BY visit_date DESC, visit_id DESC) AS d FROM visits),
s AS (SELECT subject, count(*) AS n_visits, max(CASE WHEN a = 1 THEN score END) AS initial_value,
  max(CASE WHEN d = 1 THEN score END) AS final_value FROM r GROUP BY subject HAVING count(*) >= 2)
SELECT subject, n_visits, round(initial_value, 6) AS initial_value, round(final_value, 6) AS final_value,
  round(final_value - initial_value, 6) AS total_change,
  CASE WHEN final_value - initial_value > 0.1 THEN 'progressive' WHEN final_value - initial_value < -0.1 THEN 'improving' ELSE 'stable' END AS pattern
FROM s""")
def g5(spark, sf):
    return rounded(G.progression_pattern(visits(spark, sf), KEY, ORDER, "score"))


@register("g6_gap_guarded_change", f"""WITH {VISITS}
SELECT visit_id, round(CASE WHEN t_months * 30 - lag(t_months * 30) OVER ({WIN}) >= 90
  THEN score - lag(score) OVER ({WIN}) END, 6) AS score_change_safe FROM visits""")
def g6(spark, sf):
    v = visits(spark, sf).withColumn("days", F.col("t_months") * 30)
    return rounded(G.gap_guarded_change(v, KEY, ORDER, "days", "score").select("visit_id", "score_change_safe"))


@register("g7_change_points")
def g7(spark, sf):
    return G.change_points(visits(spark, sf), KEY, ORDER, "score")


@register("g7_change_points_long")
def g7b(spark, sf):
    """One long series per kind of event; kernel sums by tiles."""
    return G.change_points(table(spark, sf, "events"), "event_type", ["ts", "event_id"], "value", tile_from=1000)


@register("g8_change_point_summary")
def g8(spark, sf):
    return rounded(G.change_point_summary(G.change_points(visits(spark, sf), KEY, ORDER, "score")))


@register("g9_temporal_summary", f"""WITH {VISITS}, p AS (SELECT subject, count(*) AS v FROM visits GROUP BY subject)
SELECT (SELECT count(*) FROM visits) AS observations, count(*) AS subjects, round(avg(v), 6) AS visits_mean,
  min(v) AS visits_min, max(v) AS visits_max, CAST((SELECT min(visit_date) FROM visits) AS VARCHAR) AS t_min,
  CAST((SELECT max(visit_date) FROM visits) AS VARCHAR) AS t_max FROM p""")
def g9(spark, sf):
    return rounded(G.temporal_summary(visits(spark, sf), KEY, "visit_date"))


@register("g10_score_horizons", f"""WITH {VISITS},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY visit_date DESC, visit_id DESC) AS rn FROM visits) WHERE rn = 1)
SELECT subject, h AS horizon_months, round(t_months + h, 6) AS future_t FROM l, (VALUES (6), (12), (24)) AS hz(h)""")
def g10(spark, sf):
    last = W.last_visit(visits(spark, sf), KEY, ORDER)
    return rounded(G.score_horizons(last, "t_months").select(KEY, "horizon_months", "future_t"))


@register("g11_date_conflicts", """SELECT l_orderkey, l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE CAST(l_shipdate AS DATE) <> CAST(o_orderdate AS DATE)""")
def g11(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return G.date_conflicts(j, "ship", "ordered").select("l_orderkey", "l_linenumber")
