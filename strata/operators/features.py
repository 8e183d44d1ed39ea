"""Domain feature sets.

Each function composes the scalar, statistics and scaling operators.  The
reference discovers columns by substring (which over-matches); here every
function takes explicit column roles.  Statistics a function needs (means,
stds, quantiles, medians) are fitted in one aggregate job before the single
projection that adds the features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import bin_code, bin_right_closed, clip, eps_ratio, flag, row_mean, row_std, safe_div
from ..functions.stats import fit_stats, lit_or_null
from .scale import zscore_exprs
from .windows import rank_pct

# FIXED VALUES taken from the reference's feature code
BIOMARKER_THRESHOLDS = {"ab42": 192.0, "tau": 240.0, "ptau": 18.0}       # low ab42, high tau / ptau
COGNITIVE_SCALES = {"mmse": (30.0, 24.0), "moca": (30.0, 26.0), "cdr": (0.0, 0.5), "adas": (0.0, 12.0)}  # (max, threshold)
MMSE_EDGES, MMSE_LABELS = [-1, 17, 23, 26, 30], [3, 2, 1, 0]
BASELINE_DAY_EDGES = [-1, 180, 365, 730, float("inf")]
AGE_EDGES = [0, 65, 75, 85, 120]
EDUCATION_EDGES = [0, 8, 12, 16, 25]
DEMO_RISK_EDGES = [float("-inf"), -0.5, 0, 0.5, float("inf")]
PET_THRESHOLDS = {"amyloid_suvr": 1.11, "centiloid": 20.0, "tau_suvr": 1.3}
CENTILOID_SLOPE, CENTILOID_OFFSET = 188.22, -18.85
STEP_EDGES = [0, 2000, 5000, 10000, float("inf")]


def _lit(v):
    return lit_or_null(v)


# -- biomarkers ---------------------------------------------------------------

def biomarker_ratios(df: DataFrame, ab42: str, ab40: str, tau: str, ptau: str, eps: float = 1e-8) -> DataFrame:
    """ab42/ab40, tau/ab42, ptau/tau with an epsilon in the divisor."""
    return df.select("*", eps_ratio(ab42, ab40, eps).alias("ab42_ab40_ratio"),
                     eps_ratio(tau, ab42, eps).alias("tau_ab42_ratio"), eps_ratio(ptau, tau, eps).alias("ptau_tau_ratio"))


def biomarker_flags(df: DataFrame, ab42: str, tau: str, ptau: str,
                    thresholds: Mapping[str, float] = BIOMARKER_THRESHOLDS) -> DataFrame:
    """ab42 below, tau / ptau above their thresholds (missing -> 0).
    In the reference a ptau column matches the tau rule first and is then
    overwritten by the ptau rule: the ptau threshold is what remains."""
    return df.select("*", flag(F.col(ab42) < thresholds["ab42"]).alias(f"{ab42}_pathological"),
                     flag(F.col(tau) > thresholds["tau"]).alias(f"{tau}_pathological"),
                     flag(F.col(ptau) > thresholds["ptau"]).alias(f"{ptau}_pathological"))


def biomarker_scores(df: DataFrame, ab42: str, tau: str, ptau: str) -> DataFrame:
    """D3: composite ``-z(ab42) + z(tau)`` and the mean z of the three markers."""
    z = zscore_exprs(df, [ab42, tau, ptau])
    return df.select("*", (-z[ab42] + z[tau]).alias("amyloid_tau_composite"),
                     row_mean([z[ab42], z[tau], z[ptau]]).alias("biomarker_risk_score"))


def zscore_interactions(df: DataFrame, a: str, b: str) -> DataFrame:
    """z(a) * z(b) and z(a) - z(b)."""
    z = zscore_exprs(df, [a, b])
    return df.select("*", (z[a] * z[b]).alias(f"{a}_x_{b}"), (z[a] - z[b]).alias(f"{a}_minus_{b}"))


def biomarker_transforms(df: DataFrame, cols: Sequence[str], skew_threshold: float = 1.5) -> DataFrame:
    """log1p of positive markers whose skewness exceeds the threshold, and
    the percentile rank of each marker."""
    from .scale import log_if_skewed
    out, _ = log_if_skewed(df, cols, skew_threshold)
    for c in cols:
        out = rank_pct(out, c, f"{c}_percentile")
    return out


# -- clinical -----------------------------------------------------------------

def cognitive_scales(df: DataFrame, cols: Mapping[str, str], scales=COGNITIVE_SCALES) -> DataFrame:
    """X / max and (x - threshold) / max per scale (a zero max -> null),
    MMSE severity 3..0 by right-closed bins, CDR impaired flag (>= 0.5)."""
    out = []
    for scale, c in cols.items():
        mx, thr = scales[scale]
        out += [safe_div(F.col(c), F.lit(mx)).alias(f"{c}_normalized"),
                safe_div(F.col(c) - F.lit(thr), F.lit(mx)).alias(f"{c}_threshold_distance")]
        if scale == "mmse":
            out.append(bin_right_closed(c, MMSE_EDGES, MMSE_LABELS, True).cast("double").alias(f"{c}_severity"))
        if scale == "cdr":
            out.append(flag(F.col(c) >= 0.5).alias(f"{c}_impaired"))
    return df.select("*", *out)


def time_since_baseline(df: DataFrame, days: str, age: str | None = None) -> DataFrame:
    """Years since baseline, its category (<=180 d, <=1 y, <=2 y, more)
    and the estimated age at the visit."""
    out = [(F.col(days) / 365.25).alias(f"{days}_years"),
           bin_right_closed(days, BASELINE_DAY_EDGES, [0, 1, 2, 3]).cast("double").alias(f"{days}_category")]
    if age:
        out.append((F.col(age) + F.col(days) / 365.25).alias("age_at_visit_estimated"))
    return df.select("*", *out)


def cognitive_composites(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per domain, the row mean of the z-scores of its columns."""
    cols = sorted({c for cs in domains.values() for c in cs})
    z = zscore_exprs(df, cols)
    return df.select("*", *[row_mean([z[c] for c in cs]).alias(f"{d}_composite") for d, cs in domains.items()])


def severe_decline(df: DataFrame, cols: Mapping[str, bool], low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Percentile rank < 0.10 for higher-is-better scores, > 0.90
    otherwise (missing -> 0)."""
    out = df
    for c, higher_better in cols.items():
        out = rank_pct(out, c, f"_{c}_pct")
        cond = F.col(f"_{c}_pct") < low if higher_better else F.col(f"_{c}_pct") > high
        out = out.withColumn(f"{c}_severe_decline", flag(cond)).drop(f"_{c}_pct")
    return out


def domain_variability(df: DataFrame, domains: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Across domain scores: std / (|mean| + eps) and range."""
    m, s = row_mean(domains), row_std(domains)
    rng = F.greatest(*[F.col(c) for c in domains]) - F.least(*[F.col(c) for c in domains])
    return df.select("*", (s / (F.abs(m) + eps)).alias("domain_variability"), rng.alias("domain_range"))


def recompute_total(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """When the total is missing and every part is present, the sum."""
    all_present = F.lit(True)
    for p in parts:
        all_present = all_present & F.col(p).isNotNull()
    s = sum((F.col(p) for p in parts), F.lit(0.0))
    return df.withColumn(total, F.when(F.col(total).isNull() & all_present, s).otherwise(F.col(total)))


def box_sum_category(df: DataFrame, c: str) -> DataFrame:
    """< 1 -> 0, <= 4 -> 1, > 4 -> 2 (null stays null), and log1p."""
    cat = F.when(F.col(c) < 1.0, 0).when(F.col(c) <= 4.0, 1).when(F.col(c) > 4.0, 2)
    return df.select("*", F.log1p(F.col(c)).alias(f"{c}_log"), cat.alias(f"{c}_category"))


# -- demographics -------------------------------------------------------------

def age_features(df: DataFrame, age: str) -> DataFrame:
    """Risk bin 0..3 (65/75/85), z-score, < 65, >= 75, squared."""
    z = zscore_exprs(df, [age])[age]
    return df.select("*", bin_right_closed(age, AGE_EDGES, [0, 1, 2, 3], True).cast("double").alias(f"{age}_risk_category"),
                     z.alias(f"{age}_standardized"), flag(F.col(age) < 65).alias(f"{age}_early_onset_risk"),
                     flag(F.col(age) >= 75).alias(f"{age}_high_risk"), F.pow(F.col(age), 2).alias(f"{age}_squared"))


def gender_features(df: DataFrame, gender: str, female_codes=(2, "Female", "F")) -> DataFrame:
    """Female flag (missing -> 0) and binary gender (null when missing)."""
    fem = F.col(gender).cast("string").isin([str(x) for x in female_codes])
    return df.select("*", flag(fem).alias(f"{gender}_female"),
                     F.when(F.col(gender).isNotNull(), fem.cast("int")).alias(f"{gender}_binary"))


def education_features(df: DataFrame, edu: str) -> DataFrame:
    """Bin 0..3 (8/12/16/25), log1p reserve, < 12, >= 16."""
    return df.select("*", bin_right_closed(edu, EDUCATION_EDGES, [0, 1, 2, 3], True).cast("double").alias(f"{edu}_category"),
                     F.log1p(F.col(edu)).alias(f"{edu}_cognitive_reserve"), flag(F.col(edu) < 12).alias(f"{edu}_low_risk"),
                     flag(F.col(edu) >= 16).alias(f"{edu}_high_protection"))


def group_features(df: DataFrame, c: str, top: int = 4) -> DataFrame:
    """One-hot of the ``top`` most frequent values and a minority flag
    (any value but the most common; missing -> 0)."""
    from ..functions.scalar import category_values, one_hot_columns
    vals = category_values(df, c, top=top)
    return df.select("*", *one_hot_columns(c, vals), flag(F.col(c) != F.lit(vals[0])).alias(f"{c}_minority"))


def demographic_interactions(df: DataFrame, age: str, female: str, edu: str) -> DataFrame:
    """z(age) x female, age / (education + 1)."""
    z = zscore_exprs(df, [age])[age]
    return df.select("*", (z * F.col(female)).alias("age_gender_interaction"),
                     safe_div(F.col(age), F.col(edu) + 1).alias("age_education_ratio"))


def demographic_risk(df: DataFrame, age_z: str, reserve: str, female: str | None = None) -> DataFrame:
    """Mean of the z-scored components (age z, -reserve, 0.5 x female)
    and its category 0..3 at -0.5 / 0 / 0.5."""
    comps = {"_c_age": F.col(age_z), "_c_res": -F.col(reserve)}
    if female:
        comps["_c_fem"] = F.col(female) * 0.5
    tmp = df.select("*", *[e.alias(n) for n, e in comps.items()])
    z = zscore_exprs(tmp, list(comps))
    score = row_mean([z[n] for n in comps])
    out = tmp.withColumn("demographic_risk_score", score)
    return out.withColumn("demographic_risk_category",
                          bin_right_closed("demographic_risk_score", DEMO_RISK_EDGES, [0, 1, 2, 3]).cast("double")).drop(*comps)


# -- genetics -----------------------------------------------------------------

def genotype_features(df: DataFrame, genotype: str, allele: str = "4") -> DataFrame:
    """Carrier (allele present), homozygous (count >= 2), allele count 0..2."""
    s = F.col(genotype).cast("string")
    cnt = F.length(s) - F.length(F.replace(s, F.lit(allele), F.lit("")))
    return df.select("*", flag(s.contains(allele)).alias("e4_carrier"), flag(cnt >= 2).alias("e4_homozygous"),
                     F.coalesce(clip(cnt, 0, 2), F.lit(0)).cast("int").alias("e4_allele_count"))


def genetic_quality(df: DataFrame, cols: Sequence[str], dates: Sequence[str], as_of: str,
                    recent_years: float = 5.0, min_share: float = 0.8) -> DataFrame:
    """Years since each test date (0..50), recent-test flag (any within
    five years), completeness share and the >= 0.8 flag."""
    from ..functions.scalar import years_since
    yrs = [years_since(d, as_of).alias(f"{d}_years_since") for d in dates]
    share = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / float(len(cols))
    recent = F.greatest(*[flag(years_since(d, as_of) <= recent_years) for d in dates]) if len(dates) > 1 \
        else flag(years_since(dates[0], as_of) <= recent_years)
    return df.select("*", *yrs, recent.alias("recent_genetic_test"), share.alias("genetic_completeness"),
                     flag(share >= min_share).alias("genetic_complete"))


# -- structural imaging -------------------------------------------------------

def normalise_volumes(df: DataFrame, cols: Sequence[str], total: str) -> DataFrame:
    """Volume / total and the z-score of the normalised volume."""
    tmp = df.select("*", *[safe_div(F.col(c), F.col(total)).alias(f"{c}_normalized") for c in cols])
    z = zscore_exprs(tmp, [f"{c}_normalized" for c in cols])
    return tmp.select("*", *[e.alias(f"{c}_zscore") for c, e in z.items()])


def structural_scores(df: DataFrame, a: str, b: str, atrophy_cols: Sequence[str]) -> DataFrame:
    """Ratio a / b (eps) and atrophy score = -(mean z of the volumes)."""
    z = zscore_exprs(df, list(atrophy_cols))
    return df.select("*", eps_ratio(a, b).alias(f"{a}_{b}_ratio"),
                     (-row_mean([z[c] for c in atrophy_cols])).alias("atrophy_score"))


# -- PET ----------------------------------------------------------------------

def pet_flags(df: DataFrame, amyloid: str | None = None, tau: str | None = None, centiloid: str | None = None,
              thresholds: Mapping[str, float] = PET_THRESHOLDS) -> DataFrame:
    """Amyloid SUVR > 1.11, tau SUVR > 1.3, centiloid > 20 and the
    lower-quartile flag of the amyloid SUVR (missing -> 0)."""
    out = []
    if amyloid:
        q = fit_stats(df, {amyloid: ["q0.25"]})[(amyloid, "q0.25")]
        out += [flag(F.col(amyloid) > thresholds["amyloid_suvr"]).alias(f"{amyloid}_positive"),
                flag(F.col(amyloid) < _lit(q)).alias(f"{amyloid}_low_quartile")]
    if tau:
        out.append(flag(F.col(tau) > thresholds["tau_suvr"]).alias(f"{tau}_positive"))
    if centiloid:
        out.append(flag(F.col(centiloid) > thresholds["centiloid"]).alias(f"{centiloid}_positive"))
    return df.select("*", *out)


def suvr_to_centiloid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """centiloid = 188.22 * (SUVR - 1) - 18.85."""
    return df.select("*", *[(F.lit(CENTILOID_SLOPE) * (F.col(c) - 1) + F.lit(CENTILOID_OFFSET)).alias(f"{c}_centiloid")
                            for c in cols])


def pet_scores(df: DataFrame, regions: Sequence[str], reference: str, left: str | None = None,
               right: str | None = None) -> DataFrame:
    """Regional ratios to a reference region, burden (mean z), coefficient
    of variation std / (mean + eps) across regions, hemispheric asymmetry
    (l - r) / (l + r + eps)."""
    z = zscore_exprs(df, list(regions))
    out = [eps_ratio(r, reference).alias(f"{r}_ratio") for r in regions]
    out += [row_mean([z[r] for r in regions]).alias("pet_burden_score"),
            (row_std(regions) / (row_mean(regions) + 1e-8)).alias("pet_cv")]
    if left and right:
        out.append(safe_div(F.col(left) - F.col(right), F.col(left) + F.col(right) + 1e-8).alias("pet_hemispheric_asymmetry"))
    return df.select("*", *out)


# -- activity and sleep -------------------------------------------------------

def activity_features(df: DataFrame, cols: Sequence[str], steps: str | None = None) -> DataFrame:
    """Row mean / std (missing std -> 0) of the activity columns, low
    activity flag at or below the 25th percentile of the mean, step category
    0..3 (0 / 2000 / 5000 / 10000, missing -> -1)."""
    tmp = df.select("*", row_mean(cols).alias("activity_mean_level"),
                    F.coalesce(row_std(cols), F.lit(0.0)).alias("activity_variability"))
    q = fit_stats(tmp, {"activity_mean_level": ["q0.25"]})[("activity_mean_level", "q0.25")]
    tmp = tmp.withColumn("low_activity_risk", flag(F.col("activity_mean_level") <= _lit(q)))
    if steps:
        tmp = tmp.withColumn(f"{steps}_category", bin_code(steps, STEP_EDGES, include_lowest=True))
    return tmp


def sleep_features(df: DataFrame, cols: Sequence[str], duration: str | None = None,
                   fragmentation: Sequence[str] = ()) -> DataFrame:
    """Sleep quality (row mean) and variability (row std, missing -> 0),
    duration adequate 6..9 / insufficient < 6 / excessive > 9, fragmentation
    index (row mean)."""
    out = [row_mean(cols).alias("sleep_quality_score"), F.coalesce(row_std(cols), F.lit(0.0)).alias("sleep_pattern_variability")]
    if duration:
        d = F.col(duration)
        out += [flag((d >= 6) & (d <= 9)).alias(f"{duration}_adequate"), flag(d < 6).alias(f"{duration}_insufficient"),
                flag(d > 9).alias(f"{duration}_excessive")]
    if fragmentation:
        out.append(row_mean(fragmentation).alias("sleep_fragmentation_index"))
    return df.select("*", *out)


def lifestyle_features(df: DataFrame, adequate: str | None = None) -> DataFrame:
    """Activity / (sleep quality + 1e-6), both-above-median balance flag,
    healthy lifestyle = mean of (1 - low activity) and adequate sleep."""
    st = fit_stats(df, {"activity_mean_level": ["median"], "sleep_quality_score": ["median"]})
    bal = flag((F.col("activity_mean_level") > _lit(st[("activity_mean_level", "median")])) &
               (F.col("sleep_quality_score") > _lit(st[("sleep_quality_score", "median")])))
    parts = [1 - F.col("low_activity_risk")] + ([F.col(adequate)] if adequate else [])
    return df.select("*", eps_ratio("activity_mean_level", "sleep_quality_score", 1e-6).alias("activity_sleep_ratio"),
                     bal.alias("activity_sleep_balance"), (sum(parts, F.lit(0)) / float(len(parts))).alias("healthy_lifestyle_score"))


def behavioural_risk(df: DataFrame, insufficient: str | None = None) -> DataFrame:
    """Mean of (low activity, insufficient sleep, variability above its
    80th percentile) and the >= 0.6 flag."""
    q = fit_stats(df, {"sleep_pattern_variability": ["q0.8"]})[("sleep_pattern_variability", "q0.8")]
    factors = [F.col("low_activity_risk")] + ([F.col(insufficient)] if insufficient else []) + \
        [flag(F.col("sleep_pattern_variability") > _lit(q))]
    score = sum(factors, F.lit(0)) / float(len(factors))
    return df.select("*", score.alias("behavioral_risk_score"), flag(score >= 0.6).alias("high_behavioral_risk"))


def daily_ratios(df: DataFrame, night: str, sleep: str, activity: str, sedentary: str, steps: str) -> DataFrame:
    """Night / sleep, activity / sedentary, steps / activity minute
    (zero divisors -> null)."""
    return df.select("*", safe_div(night, sleep).alias("night_to_sleep_ratio"),
                     safe_div(activity, sedentary).alias("activity_to_sedentary_ratio"),
                     safe_div(steps, activity).alias("step_efficiency"))
