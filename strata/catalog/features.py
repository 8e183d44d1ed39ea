"""Feature sets D1-D30 and risk / stratification R1-R12.

Bindings (FIXTURES.md B): the biomarker panel is ``lineitem`` (ab42 =
extendedprice / 200, ab40 = extendedprice / 100 + quantity, tau = quantity x 10
with nulls at orderkey % 7 = 0, ptau = tax x 500 with nulls at orderkey % 11 = 0);
subjects are ``customer`` (age = 50 + (acctbal + 1000) / 11000 x 60, education
= nation key, gender code = custkey % 3 with 0 missing); genotype text is
``part.p_brand``; the daily panel is ``events`` aggregated per (user, day).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..operators import risk as R
from .registry import register, rounded, table


def z(e, src=""):
    return f"(({e}) - avg({e}) OVER ()) / nullif(stddev_samp({e}) OVER (), 0)"


def rmean(exprs):
    s = " + ".join(f"coalesce({e}, 0)" for e in exprs)
    n = " + ".join(f"CAST(({e}) IS NOT NULL AS INTEGER)" for e in exprs)
    return f"(({s}) / nullif({n}, 0))"


def rstd(exprs):
    return f"list_stddev_samp(list_filter([{', '.join(exprs)}], lambda x: x IS NOT NULL))"


def bio(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 200).alias("ab42"),
                     (F.col("l_extendedprice") / 100 + F.col("l_quantity")).alias("ab40"),
                     F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity") * 10).alias("tau"),
                     F.when(F.col("l_orderkey") % 11 != 0, F.col("l_tax") * 500).alias("ptau"),
                     (F.col("l_quantity") * 0.6).alias("mmse"), (F.col("l_discount") * 30).alias("cdr"),
                     (F.col("l_discount") * 50).alias("cdrsb"))


BIO = """bio AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 200 AS ab42, l_extendedprice / 100 + l_quantity AS ab40,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity * 10 END AS tau, CASE WHEN l_orderkey % 11 <> 0 THEN l_tax * 500 END AS ptau,
  l_quantity * 0.6 AS mmse, l_discount * 30 AS cdr, l_discount * 50 AS cdrsb FROM lineitem)"""
K = "l_orderkey, l_linenumber"


def subj(spark, sf):
    c = table(spark, sf, "customer")
    g = F.col("c_custkey") % 3
    return c.select("c_custkey", "c_mktsegment", (50 + (F.col("c_acctbal") + 1000) / 11000 * 60).alias("age"),
                    F.col("c_nationkey").cast("double").alias("educ"), F.when(g != 0, g).alias("gender"))


SUBJ = """subj AS (SELECT c_custkey, c_mktsegment, 50 + (c_acctbal + 1000) / 11000 * 60 AS age, CAST(c_nationkey AS DOUBLE) AS educ,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 END AS gender FROM customer)"""


def daily(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    return (e.groupBy(F.col("user_id").alias("subject_id"), F.to_date("ts").alias("date"))
            .agg(F.round(F.sum(v) * 100).alias("steps"), F.sum(F.when(F.col("event_type") == "click", v)).alias("activity_minutes"),
                 F.sum(F.when(F.col("event_type") == "view", v)).alias("sleep_minutes"),
                 F.count(F.when(F.col("event_type") == "error", 1)).cast("double").alias("sleep_disruptions"),
                 F.sum(F.when(F.col("event_type") == "purchase", v)).alias("sedentary_hours"),
                 F.sum(F.when(F.hour("ts") < 6, v)).alias("night_activity_minutes")))


DAILY = """daily AS (SELECT user_id AS subject_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(sum(value) * 100) AS steps,
  sum(value) FILTER (WHERE event_type = 'click') AS activity_minutes, sum(value) FILTER (WHERE event_type = 'view') AS sleep_minutes,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS sleep_disruptions, sum(value) FILTER (WHERE event_type = 'purchase') AS sedentary_hours,
  sum(value) FILTER (WHERE hour(ts) < 6) AS night_activity_minutes FROM events GROUP BY 1, 2)"""


# -- D1-D10 ---------------------------------------------------------------------

@register("d1_biomarker_ratios", f"""WITH {BIO} SELECT {K}, round(ab42 / (ab40 + 1e-8), 6) AS ab42_ab40_ratio, round(tau / (ab42 + 1e-8), 6) AS tau_ab42_ratio,
  round(ptau / (tau + 1e-8), 6) AS ptau_tau_ratio FROM bio""")
def d1(spark, sf):
    return rounded(D.biomarker_ratios(bio(spark, sf), "ab42", "ab40", "tau", "ptau").select(
        "l_orderkey", "l_linenumber", "ab42_ab40_ratio", "tau_ab42_ratio", "ptau_tau_ratio"))


@register("d2_biomarker_flags", f"""WITH {BIO} SELECT {K}, CAST(coalesce(ab42 < 192, false) AS INTEGER) AS ab42_pathological,
  CAST(coalesce(tau > 240, false) AS INTEGER) AS tau_pathological, CAST(coalesce(ptau > 18, false) AS INTEGER) AS ptau_pathological FROM bio""")
def d2(spark, sf):
    return D.biomarker_flags(bio(spark, sf), "ab42", "tau", "ptau").select(
        "l_orderkey", "l_linenumber", "ab42_pathological", "tau_pathological", "ptau_pathological")


@register("d3_biomarker_scores", f"""WITH {BIO} SELECT {K}, round(-{z('ab42')} + {z('tau')}, 6) AS amyloid_tau_composite,
  round({rmean([z('ab42'), z('tau'), z('ptau')])}, 6) AS biomarker_risk_score FROM bio""")
def d3(spark, sf):
    return rounded(D.biomarker_scores(bio(spark, sf), "ab42", "tau", "ptau").select(
        "l_orderkey", "l_linenumber", "amyloid_tau_composite", "biomarker_risk_score"))


@register("d4_zscore_interactions", f"""WITH {BIO} SELECT {K}, round({z('ab42')} * {z('tau')}, 6) AS ab42_x_tau, round({z('ab42')} - {z('tau')}, 6) AS ab42_minus_tau FROM bio""")
def d4(spark, sf):
    return rounded(D.zscore_interactions(bio(spark, sf), "ab42", "tau").select("l_orderkey", "l_linenumber", "ab42_x_tau", "ab42_minus_tau"))


def _log_sql(c, limit=1.5):
    """log1p of a positive column whose skewness exceeds the limit, else null."""
    skew = f"(SELECT avg(power({c} - (SELECT avg({c}) FROM bio), 3)) / power(var_pop({c}), 1.5) * sqrt(count({c}) * (count({c}) - 1.0)) / (count({c}) - 2) FROM bio)"
    return f"round(CASE WHEN (SELECT min({c}) FROM bio) > 0 AND abs({skew}) > {limit} THEN ln(1 + {c}) END, 6) AS {c}_log"


def _pct_sql(c):
    return (f"round(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
            f" / (SELECT count({c}) FROM bio) END, 6) AS {c}_percentile")


@register("d5_biomarker_transforms", f"""WITH {BIO} SELECT {K}, {_log_sql('ab42')}, {_log_sql('tau')}, {_log_sql('ptau')},
  {_pct_sql('ab42')}, {_pct_sql('tau')}, {_pct_sql('ptau')} FROM bio""")
def d5(spark, sf):
    cols = ["ab42", "tau", "ptau"]
    out = D.biomarker_transforms(bio(spark, sf), cols)
    logs = [F.col(f"{c}_log") if f"{c}_log" in out.columns else F.lit(None).cast("double").alias(f"{c}_log") for c in cols]
    return rounded(out.select("l_orderkey", "l_linenumber", *logs, *[f"{c}_percentile" for c in cols]))


@register("d6_cognitive_scales", f"""WITH {BIO} SELECT {K}, round(mmse / 30.0, 6) AS mmse_normalized, round((mmse - 24) / 30.0, 6) AS mmse_threshold_distance,
  CAST(CASE WHEN mmse >= -1 AND mmse <= 17 THEN 3 WHEN mmse > 17 AND mmse <= 23 THEN 2 WHEN mmse > 23 AND mmse <= 26 THEN 1 WHEN mmse > 26 AND mmse <= 30 THEN 0 END AS DOUBLE) AS mmse_severity,
  CAST(NULL AS DOUBLE) AS cdr_normalized, CAST(NULL AS DOUBLE) AS cdr_threshold_distance, CAST(coalesce(cdr >= 0.5, false) AS INTEGER) AS cdr_impaired FROM bio""")
def d6(spark, sf):
    out = D.cognitive_scales(bio(spark, sf), {"mmse": "mmse", "cdr": "cdr"})
    return rounded(out.select("l_orderkey", "l_linenumber", "mmse_normalized", "mmse_threshold_distance", "mmse_severity",
                              "cdr_normalized", "cdr_threshold_distance", "cdr_impaired"))


@register("d7_time_since_baseline", f"""WITH {SUBJ}, v AS (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days FROM orders)
SELECT o_orderkey, round(days / 365.25, 6) AS days_years, CAST(CASE WHEN days > -1 AND days <= 180 THEN 0 WHEN days > 180 AND days <= 365 THEN 1 WHEN days > 365 AND days <= 730 THEN 2 WHEN days > 730 THEN 3 END AS DOUBLE) AS days_category,
  round(age + days / 365.25, 6) AS age_at_visit_estimated FROM v JOIN subj ON o_custkey = c_custkey""")
def d7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey",
                                          F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("days"))
    j = o.join(subj(spark, sf), o.o_custkey == F.col("c_custkey"))
    return rounded(D.time_since_baseline(j, "days", "age").select("o_orderkey", "days_years", "days_category", "age_at_visit_estimated"))


@register("d8_cognitive_composites", f"""WITH {BIO} SELECT {K}, round({rmean([z('mmse'), z('tau')])}, 6) AS memory_composite, round({rmean([z('cdr'), z('ptau')])}, 6) AS function_composite FROM bio""")
def d8(spark, sf):
    out = D.cognitive_composites(bio(spark, sf), {"memory": ["mmse", "tau"], "function": ["cdr", "ptau"]})
    return rounded(out.select("l_orderkey", "l_linenumber", "memory_composite", "function_composite"))


def _pct(c):
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END"


@register("d9_severe_decline", f"""WITH {BIO} SELECT {K}, CAST(coalesce({_pct('mmse')} < 0.1, false) AS INTEGER) AS mmse_severe_decline,
  CAST(coalesce({_pct('tau')} > 0.9, false) AS INTEGER) AS tau_severe_decline FROM bio""")
def d9(spark, sf):
    out = D.severe_decline(bio(spark, sf), {"mmse": True, "tau": False})
    return out.select("l_orderkey", "l_linenumber", "mmse_severe_decline", "tau_severe_decline")


@register("d10_domain_variability", f"""WITH {BIO} SELECT {K}, round({rstd(['mmse', 'tau', 'ptau'])} / (abs({rmean(['mmse', 'tau', 'ptau'])}) + 1e-8), 6) AS domain_variability,
  round(greatest(mmse, tau, ptau) - least(mmse, tau, ptau), 6) AS domain_range FROM bio""")
def d10(spark, sf):
    return rounded(D.domain_variability(bio(spark, sf), ["mmse", "tau", "ptau"]).select(
        "l_orderkey", "l_linenumber", "domain_variability", "domain_range"))


# -- D11-D18 --------------------------------------------------------------------

@register("d11_age_features", f"""WITH {SUBJ} SELECT c_custkey, CAST(CASE WHEN age >= 0 AND age <= 65 THEN 0 WHEN age > 65 AND age <= 75 THEN 1 WHEN age > 75 AND age <= 85 THEN 2 WHEN age > 85 AND age <= 120 THEN 3 END AS DOUBLE) AS age_risk_category,
  round({z('age')}, 6) AS age_standardized, CAST(age < 65 AS INTEGER) AS age_early_onset_risk, CAST(age >= 75 AS INTEGER) AS age_high_risk, round(age * age, 6) AS age_squared FROM subj""")
def d11(spark, sf):
    return rounded(D.age_features(subj(spark, sf), "age").select(
        "c_custkey", "age_risk_category", "age_standardized", "age_early_onset_risk", "age_high_risk", "age_squared"))


@register("d12_gender_features", f"""WITH {SUBJ} SELECT c_custkey, CAST(coalesce(gender = 2, false) AS INTEGER) AS gender_female, CAST(gender = 2 AS INTEGER) AS gender_binary FROM subj""")
def d12(spark, sf):
    return D.gender_features(subj(spark, sf), "gender").select("c_custkey", "gender_female", "gender_binary")


@register("d13_education_features", f"""WITH {SUBJ} SELECT c_custkey, CAST(CASE WHEN educ >= 0 AND educ <= 8 THEN 0 WHEN educ > 8 AND educ <= 12 THEN 1 WHEN educ > 12 AND educ <= 16 THEN 2 WHEN educ > 16 AND educ <= 25 THEN 3 END AS DOUBLE) AS educ_category,
  round(ln(1 + educ), 6) AS educ_cognitive_reserve, CAST(educ < 12 AS INTEGER) AS educ_low_risk, CAST(educ >= 16 AS INTEGER) AS educ_high_protection FROM subj""")
def d13(spark, sf):
    return rounded(D.education_features(subj(spark, sf), "educ").select(
        "c_custkey", "educ_category", "educ_cognitive_reserve", "educ_low_risk", "educ_high_protection"))


@register("d14_group_features", """WITH t AS (SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 4),
r AS (SELECT c_mktsegment, row_number() OVER (ORDER BY n DESC, c_mktsegment) AS rk FROM t)
SELECT c_custkey, c_mktsegment, CAST(c_mktsegment IN (SELECT c_mktsegment FROM r WHERE rk = 1) AS INTEGER) AS top1,
  CAST(c_mktsegment IN (SELECT c_mktsegment FROM r WHERE rk = 2) AS INTEGER) AS top2, CAST(c_mktsegment IN (SELECT c_mktsegment FROM r WHERE rk = 3) AS INTEGER) AS top3,
  CAST(c_mktsegment IN (SELECT c_mktsegment FROM r WHERE rk = 4) AS INTEGER) AS top4,
  CAST(c_mktsegment NOT IN (SELECT c_mktsegment FROM r WHERE rk = 1) AS INTEGER) AS c_mktsegment_minority FROM customer""")
def d14(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = D.group_features(c, "c_mktsegment", 4)
    onehot = [x for x in out.columns if x.startswith("c_mktsegment_") and x != "c_mktsegment_minority"]
    # one-hot columns are named after the values; expose them by frequency rank for the check
    from ..functions.scalar import category_values
    vals = category_values(c, "c_mktsegment", top=4)
    names = [f"c_mktsegment_{str(v).lower().replace(' ', '_')}" for v in vals]
    return out.select("c_custkey", "c_mktsegment", *[F.col(n).alias(f"top{i + 1}") for i, n in enumerate(names)], "c_mktsegment_minority")


@register("d15_demographic_interactions", f"""WITH {SUBJ}, g AS (SELECT *, CAST(coalesce(gender = 2, false) AS INTEGER) AS fem FROM subj)
SELECT c_custkey, round({z('age')} * fem, 6) AS age_gender_interaction, round(age / nullif(educ + 1, 0), 6) AS age_education_ratio FROM g""")
def d15(spark, sf):
    s = D.gender_features(subj(spark, sf), "gender")
    return rounded(D.demographic_interactions(s, "age", "gender_female", "educ").select(
        "c_custkey", "age_gender_interaction", "age_education_ratio"))


@register("d16_demographic_risk", f"""WITH {SUBJ}, a AS (SELECT c_custkey, {z('age')} AS az, -ln(1 + educ) AS res, CAST(coalesce(gender = 2, false) AS INTEGER) * 0.5 AS fem FROM subj),
s AS (SELECT c_custkey, {rmean([z('az'), z('res'), z('fem')])} AS sc FROM a)
SELECT c_custkey, round(sc, 6) AS demographic_risk_score, CAST(CASE WHEN sc <= -0.5 THEN 0 WHEN sc <= 0 THEN 1 WHEN sc <= 0.5 THEN 2 WHEN sc > 0.5 THEN 3 END AS DOUBLE) AS demographic_risk_category FROM s""")
def d16(spark, sf):
    s = D.education_features(D.gender_features(D.age_features(subj(spark, sf), "age"), "gender"), "educ")
    out = D.demographic_risk(s, "age_standardized", "educ_cognitive_reserve", "gender_female")
    return rounded(out.select("c_custkey", "demographic_risk_score", "demographic_risk_category"))


@register("d17_genotype_features", """SELECT p_partkey, CAST(contains(p_brand, '4') AS INTEGER) AS e4_carrier,
  CAST(length(p_brand) - length(replace(p_brand, '4', '')) >= 2 AS INTEGER) AS e4_homozygous,
  CAST(least(greatest(length(p_brand) - length(replace(p_brand, '4', '')), 0), 2) AS INTEGER) AS e4_allele_count FROM part""")
def d17(spark, sf):
    return D.genotype_features(table(spark, sf, "part"), "p_brand").select("p_partkey", "e4_carrier", "e4_homozygous", "e4_allele_count")


@register("d18_genetic_quality", """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 400 END AS d2,
  o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS st, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS pr FROM orders),
y AS (SELECT *, least(greatest(date_diff('day', d1, DATE '1999-01-01') / 365.25, 0), 50) AS y1,
  CASE WHEN d2 IS NOT NULL THEN least(greatest(date_diff('day', d2, DATE '1999-01-01') / 365.25, 0), 50) END AS y2 FROM t)
SELECT o_orderkey, round(y1, 6) AS d1_years_since, round(y2, 6) AS d2_years_since, greatest(CAST(coalesce(y1 <= 5, false) AS INTEGER), CAST(coalesce(y2 <= 5, false) AS INTEGER)) AS recent_genetic_test,
  round((CAST(o_totalprice IS NOT NULL AS INTEGER) + CAST(st IS NOT NULL AS INTEGER) + CAST(pr IS NOT NULL AS INTEGER)) / 3.0, 6) AS genetic_completeness,
  CAST((CAST(o_totalprice IS NOT NULL AS INTEGER) + CAST(st IS NOT NULL AS INTEGER) + CAST(pr IS NOT NULL AS INTEGER)) / 3.0 >= 0.8 AS INTEGER) AS genetic_complete FROM y""")
def d18(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d1"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), 400)).alias("d2"), "o_totalprice",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("st"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("pr"))
    out = D.genetic_quality(o, ["o_totalprice", "st", "pr"], ["d1", "d2"], "1999-01-01")
    return rounded(out.select("o_orderkey", "d1_years_since", "d2_years_since", "recent_genetic_test", "genetic_completeness", "genetic_complete"))


# -- D19-D23 --------------------------------------------------------------------

@register("d19_normalise_volumes", f"""WITH {BIO}, n AS (SELECT {K}, tau / nullif(ab40, 0) AS tau_normalized, ptau / nullif(ab40, 0) AS ptau_normalized FROM bio)
SELECT {K}, round(tau_normalized, 6) AS tau_normalized, round(ptau_normalized, 6) AS ptau_normalized, round({z('tau_normalized')}, 6) AS tau_normalized_zscore,
  round({z('ptau_normalized')}, 6) AS ptau_normalized_zscore FROM n""")
def d19(spark, sf):
    out = D.normalise_volumes(bio(spark, sf), ["tau", "ptau"], "ab40")
    return rounded(out.select("l_orderkey", "l_linenumber", "tau_normalized", "ptau_normalized", "tau_normalized_zscore", "ptau_normalized_zscore"))


@register("d20_structural_scores", f"""WITH {BIO} SELECT {K}, round(tau / (ab40 + 1e-8), 6) AS tau_ab40_ratio, round(-{rmean([z('tau'), z('ab42')])}, 6) AS atrophy_score FROM bio""")
def d20(spark, sf):
    return rounded(D.structural_scores(bio(spark, sf), "tau", "ab40", ["tau", "ab42"]).select(
        "l_orderkey", "l_linenumber", "tau_ab40_ratio", "atrophy_score"))


def pet(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (1 + F.col("l_discount") * 5).alias("amy"), (1 + F.col("l_tax") * 5).alias("tausuvr"),
                     (1 + F.col("l_quantity") / 100).alias("front"), (1 + F.col("l_quantity") / 120).alias("right_region"),
                     (1 + F.col("l_discount")).alias("ref"))


PET = """pet AS (SELECT l_orderkey, l_linenumber, 1 + l_discount * 5 AS amy, 1 + l_tax * 5 AS tausuvr, 1 + l_quantity / 100 AS front,
  1 + l_quantity / 120 AS right_region, 1 + l_discount AS ref FROM lineitem)"""


@register("d21_pet_flags", f"""WITH {PET} SELECT {K}, CAST(amy > 1.11 AS INTEGER) AS amy_positive, CAST(amy < (SELECT quantile_cont(amy, 0.25) FROM pet) AS INTEGER) AS amy_low_quartile,
  CAST(tausuvr > 1.3 AS INTEGER) AS tausuvr_positive, CAST(188.22 * (amy - 1) - 18.85 > 20 AS INTEGER) AS amy_centiloid_positive FROM pet""")
def d21(spark, sf):
    p = D.suvr_to_centiloid(pet(spark, sf), ["amy"])
    out = D.pet_flags(p, amyloid="amy", tau="tausuvr", centiloid="amy_centiloid")
    return out.select("l_orderkey", "l_linenumber", "amy_positive", "amy_low_quartile", "tausuvr_positive", "amy_centiloid_positive")


@register("d22_suvr_to_centiloid", f"WITH {PET} SELECT {K}, round(188.22 * (amy - 1) - 18.85, 6) AS amy_centiloid FROM pet")
def d22(spark, sf):
    return rounded(D.suvr_to_centiloid(pet(spark, sf), ["amy"]).select("l_orderkey", "l_linenumber", "amy_centiloid"))


@register("d23_pet_scores", f"""WITH {PET} SELECT {K}, round(amy / (ref + 1e-8), 6) AS amy_ratio, round(front / (ref + 1e-8), 6) AS front_ratio,
  round({rmean([z('amy'), z('front')])}, 6) AS pet_burden_score, round({rstd(['amy', 'front'])} / ({rmean(['amy', 'front'])} + 1e-8), 6) AS pet_cv,
  round((front - right_region) / nullif(front + right_region + 1e-8, 0), 6) AS pet_hemispheric_asymmetry FROM pet""")
def d23(spark, sf):
    out = D.pet_scores(pet(spark, sf), ["amy", "front"], "ref", "front", "right_region")
    return rounded(out.select("l_orderkey", "l_linenumber", "amy_ratio", "front_ratio", "pet_burden_score", "pet_cv", "pet_hemispheric_asymmetry"))


# -- D24-D30 --------------------------------------------------------------------

ACT_SQL = f"""{DAILY}, a AS (SELECT *, {rmean(['steps', 'activity_minutes'])} AS activity_mean_level,
  coalesce({rstd(['steps', 'activity_minutes'])}, 0) AS activity_variability FROM daily),
a2 AS (SELECT *, CAST(coalesce(activity_mean_level <= (SELECT quantile_cont(activity_mean_level, 0.25) FROM a), false) AS INTEGER) AS low_activity_risk,
  CAST(coalesce(CASE WHEN steps >= 0 AND steps <= 2000 THEN 0 WHEN steps > 2000 AND steps <= 5000 THEN 1 WHEN steps > 5000 AND steps <= 10000 THEN 2 WHEN steps > 10000 THEN 3 END, -1) AS INTEGER) AS steps_category FROM a),
s AS (SELECT *, {rmean(['sleep_minutes', 'sleep_disruptions'])} AS sleep_quality_score, coalesce({rstd(['sleep_minutes', 'sleep_disruptions'])}, 0) AS sleep_pattern_variability,
  CAST(coalesce(sleep_minutes / 10 >= 6 AND sleep_minutes / 10 <= 9, false) AS INTEGER) AS hours_adequate, CAST(coalesce(sleep_minutes / 10 < 6, false) AS INTEGER) AS hours_insufficient,
  CAST(coalesce(sleep_minutes / 10 > 9, false) AS INTEGER) AS hours_excessive, sleep_disruptions AS sleep_fragmentation_index FROM a2)"""


def act(spark, sf):
    d = daily(spark, sf).withColumn("hours", F.col("sleep_minutes") / 10)
    a = D.activity_features(d, ["steps", "activity_minutes"], "steps")
    return D.sleep_features(a, ["sleep_minutes", "sleep_disruptions"], "hours", ["sleep_disruptions"])


@register("d24_activity_features", f"""WITH {ACT_SQL} SELECT subject_id, date, round(activity_mean_level, 6) AS activity_mean_level, round(activity_variability, 6) AS activity_variability,
  low_activity_risk, steps_category FROM s""")
def d24(spark, sf):
    return rounded(act(spark, sf).select("subject_id", "date", "activity_mean_level", "activity_variability", "low_activity_risk", "steps_category"))


@register("d25_sleep_features", f"""WITH {ACT_SQL} SELECT subject_id, date, round(sleep_quality_score, 6) AS sleep_quality_score, round(sleep_pattern_variability, 6) AS sleep_pattern_variability,
  hours_adequate, hours_insufficient, hours_excessive, round(sleep_fragmentation_index, 6) AS sleep_fragmentation_index FROM s""")
def d25(spark, sf):
    return rounded(act(spark, sf).select("subject_id", "date", "sleep_quality_score", "sleep_pattern_variability", "hours_adequate",
                                         "hours_insufficient", "hours_excessive", "sleep_fragmentation_index"))


@register("d26_lifestyle_features", f"""WITH {ACT_SQL} SELECT subject_id, date, round(activity_mean_level / (sleep_quality_score + 1e-6), 6) AS activity_sleep_ratio,
  CAST(coalesce(activity_mean_level > (SELECT median(activity_mean_level) FROM s) AND sleep_quality_score > (SELECT median(sleep_quality_score) FROM s), false) AS INTEGER) AS activity_sleep_balance,
  round(((1 - low_activity_risk) + hours_adequate) / 2.0, 6) AS healthy_lifestyle_score FROM s""")
def d26(spark, sf):
    return rounded(D.lifestyle_features(act(spark, sf), "hours_adequate").select(
        "subject_id", "date", "activity_sleep_ratio", "activity_sleep_balance", "healthy_lifestyle_score"))


@register("d27_behavioural_risk", f"""WITH {ACT_SQL}, b AS (SELECT subject_id, date, (low_activity_risk + hours_insufficient +
  CAST(coalesce(sleep_pattern_variability > (SELECT quantile_cont(sleep_pattern_variability, 0.8) FROM s), false) AS INTEGER)) / 3.0 AS sc FROM s)
SELECT subject_id, date, round(sc, 6) AS behavioral_risk_score, CAST(sc >= 0.6 AS INTEGER) AS high_behavioral_risk FROM b""")
def d27(spark, sf):
    return rounded(D.behavioural_risk(act(spark, sf), "hours_insufficient").select(
        "subject_id", "date", "behavioral_risk_score", "high_behavioral_risk"))


@register("d28_daily_ratios", f"""WITH {DAILY} SELECT subject_id, date, round(night_activity_minutes / nullif(sleep_minutes, 0), 6) AS night_to_sleep_ratio,
  round(activity_minutes / nullif(sedentary_hours, 0), 6) AS activity_to_sedentary_ratio, round(steps / nullif(activity_minutes, 0), 6) AS step_efficiency FROM daily""")
def d28(spark, sf):
    out = D.daily_ratios(daily(spark, sf), "night_activity_minutes", "sleep_minutes", "activity_minutes", "sedentary_hours", "steps")
    return rounded(out.select("subject_id", "date", "night_to_sleep_ratio", "activity_to_sedentary_ratio", "step_efficiency"))


@register("d29_recompute_total", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity + l_discount * 100 END AS total,
  l_quantity AS p1, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount * 100 END AS p2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN total IS NULL AND p1 IS NOT NULL AND p2 IS NOT NULL THEN p1 + p2 ELSE total END, 6) AS total FROM t""")
def d29(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity") + F.col("l_discount") * 100).alias("total"),
        F.col("l_quantity").alias("p1"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount") * 100).alias("p2"))
    return rounded(D.recompute_total(li, "total", ["p1", "p2"]).select("l_orderkey", "l_linenumber", "total"))


@register("d30_box_sum_category", f"""WITH {BIO} SELECT {K}, round(ln(1 + cdrsb), 6) AS cdrsb_log, CASE WHEN cdrsb < 1 THEN 0 WHEN cdrsb <= 4 THEN 1 WHEN cdrsb > 4 THEN 2 END AS cdrsb_category FROM bio""")
def d30(spark, sf):
    return rounded(D.box_sum_category(bio(spark, sf), "cdrsb").select("l_orderkey", "l_linenumber", "cdrsb_log", "cdrsb_category"))


# -- R1-R12 ---------------------------------------------------------------------
# Risk table: one row per lineitem; biomarker risk (D3), genetic risk = allele
# count of the part's brand (D17), demographic risk = customer age z (via
# orders), behavioural component = discount (already 0..0.1), carrier flag.

def risk_table(spark, sf):
    b = D.biomarker_scores(bio(spark, sf), "ab42", "tau", "ptau")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    g = D.genotype_features(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = subj(spark, sf).select("c_custkey", "age")
    t = (b.join(li, ["l_orderkey", "l_linenumber"]).join(g, li.l_partkey == g.p_partkey, "left")
         .join(o, F.col("l_orderkey") == o.o_orderkey, "left").join(s, F.col("o_custkey") == s.c_custkey, "left"))
    return t.select("l_orderkey", "l_linenumber", "biomarker_risk_score", F.col("e4_allele_count").cast("double").alias("genetic_risk"),
                    "age", F.col("l_discount").alias("behavioral_risk"), "e4_carrier")


RISK = f"""{BIO}, b AS (SELECT {K}, {rmean([z('ab42'), z('tau'), z('ptau')])} AS biomarker_risk_score FROM bio),
rt AS (SELECT b.l_orderkey, b.l_linenumber, biomarker_risk_score,
  CAST(least(greatest(length(p_brand) - length(replace(p_brand, '4', '')), 0), 2) AS DOUBLE) AS genetic_risk,
  50 + (c_acctbal + 1000) / 11000 * 60 AS age, l_discount AS behavioral_risk, CAST(contains(p_brand, '4') AS INTEGER) AS e4_carrier
  FROM b JOIN lineitem l ON b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN orders ON b.l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""


def _mm(c):
    return f"(({c}) - (SELECT min({c}) FROM rt)) / ((SELECT max({c}) - min({c}) FROM rt) + 1e-6)"


COMPOSITE_SQL = f"""(coalesce({_mm('genetic_risk')}, 0) * 0.2 + coalesce({_mm('age')}, 0) * 0.15 + coalesce({_mm('biomarker_risk_score')}, 0) * 0.25
  + coalesce(behavioral_risk, 0) * 0.1) / 0.7"""


def scored(spark, sf):
    comps = {"genetic": ("genetic_risk", R.RISK_WEIGHTS["genetic"]), "demographic": ("age", R.RISK_WEIGHTS["demographic"]),
             "biomarker": ("biomarker_risk_score", R.RISK_WEIGHTS["biomarker"]),
             "behavioral": ("behavioral_risk", R.RISK_WEIGHTS["behavioral"])}
    return R.risk_category(R.composite_risk(risk_table(spark, sf), comps))


CAT_SQL = "CASE WHEN s >= 0 AND s <= 0.33 THEN 'Low' WHEN s > 0.33 AND s <= 0.66 THEN 'Moderate' WHEN s > 0.66 AND s <= 1.0 THEN 'High' END"
SCORED = f"""{RISK}, sc AS (SELECT *, {COMPOSITE_SQL} AS s FROM rt), cat AS (SELECT *, {CAT_SQL} AS risk_category FROM sc)"""


@register("r1_composite_risk", f"WITH {RISK} SELECT {K}, round({COMPOSITE_SQL}, 6) AS composite_risk_score FROM rt")
def r1(spark, sf):
    return rounded(scored(spark, sf).select("l_orderkey", "l_linenumber", "composite_risk_score"))


@register("r2_risk_category", f"WITH {SCORED} SELECT {K}, risk_category FROM cat")
def r2(spark, sf):
    return scored(spark, sf).select("l_orderkey", "l_linenumber", "risk_category")


@register("r3_cross_modal", f"""WITH {RISK} SELECT {K}, round({rmean(['CAST(genetic_risk IS NOT NULL AS DOUBLE)', 'CAST(biomarker_risk_score IS NOT NULL AS DOUBLE)'])}, 6) AS multimodal_completeness,
  round(genetic_risk * ln(1 + coalesce(age, (SELECT median(age) FROM rt))), 6) AS genetic_age_interaction,
  round(behavioral_risk * (1 - biomarker_risk_score), 6) AS lifestyle_biomarker_interaction,
  round({rmean(['biomarker_risk_score', 'genetic_risk'])}, 6) AS neuroimaging_combined_risk FROM rt""")
def r3(spark, sf):
    t = risk_table(spark, sf).withColumn("_cg", F.col("genetic_risk").isNotNull().cast("double")) \
        .withColumn("_cb", F.col("biomarker_risk_score").isNotNull().cast("double"))
    out = R.cross_modal(t, ["_cg", "_cb"], "genetic_risk", "age", "behavioral_risk", "biomarker_risk_score",
                        ["biomarker_risk_score", "genetic_risk"])
    return rounded(out.select("l_orderkey", "l_linenumber", "multimodal_completeness", "genetic_age_interaction",
                              "lifestyle_biomarker_interaction", "neuroimaging_combined_risk"))


@register("r4_completeness_score", f"""WITH {RISK}, c AS (SELECT {K}, 1 - {rmean(['CAST(genetic_risk IS NOT NULL AS DOUBLE)', 'CAST(biomarker_risk_score IS NOT NULL AS DOUBLE)'])} AS s FROM rt)
SELECT {K}, round(s, 6) AS composite_risk_score, {CAT_SQL} AS risk_category FROM c""")
def r4(spark, sf):
    t = risk_table(spark, sf).withColumn("_cg", F.col("genetic_risk").isNotNull().cast("double")) \
        .withColumn("_cb", F.col("biomarker_risk_score").isNotNull().cast("double"))
    out = R.completeness_score(R.cross_modal(t, ["_cg", "_cb"]))
    return rounded(out.select("l_orderkey", "l_linenumber", "composite_risk_score", "risk_category"))


PROFILE_SQL = f"""p AS (SELECT avg(s) FILTER (WHERE e4_carrier = 0) AS mean_non_carrier, stddev_samp(s) FILTER (WHERE e4_carrier = 0) AS std_non_carrier,
  count(s) FILTER (WHERE e4_carrier = 0) AS count_non_carrier, avg(s) FILTER (WHERE e4_carrier = 1) AS mean_carrier,
  stddev_samp(s) FILTER (WHERE e4_carrier = 1) AS std_carrier, count(s) FILTER (WHERE e4_carrier = 1) AS count_carrier FROM cat)"""


@register("r5_carrier_profile", f"""WITH {SCORED}, {PROFILE_SQL}
SELECT round(mean_non_carrier, 6) AS mean_non_carrier, round(std_non_carrier, 6) AS std_non_carrier, count_non_carrier, round(mean_carrier, 6) AS mean_carrier,
  round(std_carrier, 6) AS std_carrier, count_carrier, round(mean_carrier / mean_non_carrier, 6) AS risk_multiplier, round(mean_carrier - std_carrier, 6) AS high_risk_threshold FROM p""")
def r5(spark, sf):
    return rounded(R.carrier_profile(scored(spark, sf), "e4_carrier", "composite_risk_score"))


@register("r6_carrier_adjust", f"""WITH {SCORED},
m AS (SELECT {K}, e4_carrier, s, avg(s) FILTER (WHERE e4_carrier = 1) OVER () / avg(s) FILTER (WHERE e4_carrier = 0) OVER () AS multiplier FROM cat)
SELECT {K}, CASE WHEN e4_carrier = 1 THEN 'High_Genetic_Risk' WHEN e4_carrier = 0 THEN 'Low_Genetic_Risk' END AS genetic_risk_stratum,
  round(CASE WHEN e4_carrier = 1 THEN s * multiplier ELSE s END, 6) AS genetic_adjusted_risk FROM m""")
def r6(spark, sf):
    out = R.carrier_adjust(scored(spark, sf), "e4_carrier", "composite_risk_score")
    return rounded(out.select("l_orderkey", "l_linenumber", "genetic_risk_stratum", "genetic_adjusted_risk"))


HIER_SQL = """CASE WHEN risk_category = 'Low' AND e4_carrier = 1 THEN 'Low_Risk_APOE4_Carrier'
  WHEN risk_category = 'Moderate' AND biomarker_risk_score > (SELECT quantile_cont(biomarker_risk_score, 0.75) FROM cat) THEN 'Moderate_Risk_High_Biomarkers'
  WHEN risk_category = 'High' AND e4_carrier = 0 THEN 'High_Risk_Non_APOE4' WHEN risk_category = 'High' AND e4_carrier = 1 THEN 'Critical_High_Risk_APOE4' ELSE 'Other' END"""


@register("r7_hierarchical_stratum", f"WITH {SCORED} SELECT {K}, {HIER_SQL} AS hierarchical_stratum FROM cat")
def r7(spark, sf):
    return R.hierarchical_stratum(scored(spark, sf), "risk_category", "e4_carrier", "biomarker_risk_score").select(
        "l_orderkey", "l_linenumber", "hierarchical_stratum")


THR_SQL = """CASE WHEN biomarker_risk_score >= (SELECT quantile_cont(biomarker_risk_score, 0.67) FROM cat) THEN 'High_Biomarker_Risk'
  WHEN biomarker_risk_score <= (SELECT quantile_cont(biomarker_risk_score, 0.33) FROM cat) THEN 'Low_Biomarker_Risk' ELSE 'Moderate_Biomarker_Risk' END"""


@register("r8_threshold_stratum", f"WITH {SCORED} SELECT {K}, {THR_SQL} AS biomarker_stratum FROM cat")
def r8(spark, sf):
    return R.threshold_stratum(scored(spark, sf), "biomarker_risk_score").select("l_orderkey", "l_linenumber", "biomarker_stratum")


@register("r9_cluster_stratum")
def r9(spark, sf):
    t = risk_table(spark, sf)
    return R.cluster_stratum(t, ["biomarker_risk_score", "genetic_risk"]).select(
        "l_orderkey", "l_linenumber", "biomarker_cluster", "biomarker_stratum")


def _combined(spark, sf):
    s = scored(spark, sf)
    s = R.carrier_adjust(s, "e4_carrier", "composite_risk_score")
    s = R.hierarchical_stratum(s, "risk_category", "e4_carrier", "biomarker_risk_score")
    s = R.threshold_stratum(s, "biomarker_risk_score")
    return R.combined_stratum(s)


@register("r10_combined_stratum", f"""WITH {SCORED}, h AS (SELECT *, {HIER_SQL} AS hs, {THR_SQL} AS bs FROM cat)
SELECT {K}, CASE WHEN (e4_carrier = 1 AND hs = 'Critical_High_Risk_APOE4') OR (bs = 'High_Biomarker_Risk' AND risk_category = 'High') THEN 'Critical_Multi_Risk' ELSE 'Standard_Risk' END AS comprehensive_stratum FROM h""")
def r10(spark, sf):
    return _combined(spark, sf).select("l_orderkey", "l_linenumber", "comprehensive_stratum")


@register("r11_stratum_metrics", f"""WITH {SCORED}, h AS (SELECT {K}, risk_category, {HIER_SQL} AS hierarchical_stratum FROM cat)
SELECT 'total_samples' AS metric, count(*)::DOUBLE AS value FROM h
UNION ALL SELECT 'stratification_completeness', round((count(l_orderkey) + count(l_linenumber) + count(risk_category) + count(hierarchical_stratum)) / (count(*) * 4.0), 6) FROM h
UNION ALL SELECT 'risk_category_unique_strata', count(DISTINCT risk_category)::DOUBLE FROM h
UNION ALL SELECT 'hierarchical_stratum_unique_strata', count(DISTINCT hierarchical_stratum)::DOUBLE FROM h
UNION ALL SELECT 'risk_category_' || risk_category || '_proportion', round(count(*)::DOUBLE / (SELECT count(risk_category) FROM h), 6) FROM h WHERE risk_category IS NOT NULL GROUP BY risk_category
UNION ALL SELECT 'hierarchical_stratum_' || hierarchical_stratum || '_proportion', round(count(*)::DOUBLE / (SELECT count(*) FROM h), 6) FROM h GROUP BY hierarchical_stratum""")
def r11(spark, sf):
    s = R.hierarchical_stratum(scored(spark, sf), "risk_category", "e4_carrier", "biomarker_risk_score")
    s = s.select("l_orderkey", "l_linenumber", "risk_category", "hierarchical_stratum")
    return rounded(R.stratum_metrics(s, ["risk_category", "hierarchical_stratum"]))


LABEL_SQL = "regexp_extract({}, '(Low|Moderate|High|Critical)', 1)"


@register("r12_consensus_stratum", f"""WITH {SCORED}, h AS (SELECT *, {HIER_SQL} AS hs, {THR_SQL} AS bs FROM cat),
l AS (SELECT {K}, {LABEL_SQL.format('risk_category')} AS a, {LABEL_SQL.format('bs')} AS b, {LABEL_SQL.format('hs')} AS c FROM h)
SELECT {K}, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE coalesce(a, b, c) END AS consensus_stratum FROM l""")
def r12(spark, sf):
    s = _combined(spark, sf)
    lab = lambda c: F.regexp_extract(F.col(c), "(Low|Moderate|High|Critical)", 1)
    s = s.select("l_orderkey", "l_linenumber", lab("risk_category").alias("a"), lab("biomarker_stratum").alias("b"),
                 lab("hierarchical_stratum").alias("c"))
    return R.consensus_stratum(s, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "consensus_stratum")
