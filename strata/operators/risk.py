"""Composite risk score and stratification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import bin_right_closed, row_mean
from ..functions.stats import fit_stats, lit_or_null
from ..session import cut_lineage
from .agg import value_counts
from .kmeans import fit_kmeans

# FIXED VALUES: composite weights and category cut points of the reference
RISK_WEIGHTS = {"genetic": 0.20, "demographic": 0.15, "biomarker": 0.25, "neuroimaging": 0.25,
                "mri": 0.15, "pet": 0.10, "behavioral": 0.10, "clinical": 0.05}
RISK_EDGES, RISK_LABELS = [0, 0.33, 0.66, 1.0], ["Low", "Moderate", "High"]


def composite_risk(df: DataFrame, components: Mapping[str, tuple[str, float]], raw: Sequence[str] = ("behavioral",),
                   eps: float = 1e-6, out: str = "composite_risk_score") -> DataFrame:
    """Every component min-max normalised ``(x - min) / (max - min + eps)``
    (components listed in ``raw`` are used as they are), missing -> 0, then
    the weighted mean with weights renormalised to sum to 1."""
    norm_cols = [c for name, (c, _) in components.items() if name not in raw]
    st = fit_stats(df, {c: ["min", "max"] for c in norm_cols}) if norm_cols else {}
    total_w = sum(w for _, w in components.values())
    terms, adds = [], []
    for name, (c, w) in components.items():
        if name in raw:
            v = F.col(c).cast("double")
        else:
            lo, hi = st[(c, "min")], st[(c, "max")]
            v = (F.col(c) - lit_or_null(lo)) / (lit_or_null(hi) - lit_or_null(lo) + eps)
        adds.append(v.alias(f"{c}_norm"))
        terms.append(F.coalesce(F.col(f"{c}_norm"), F.lit(0.0)) * (w / total_w))
    tmp = df.select("*", *adds)
    return tmp.withColumn(out, sum(terms, F.lit(0.0)))


def risk_category(df: DataFrame, c: str = "composite_risk_score", out: str = "risk_category") -> DataFrame:
    """R2: Low / Moderate / High at 0 / .33 / .66 / 1 (right-closed, lowest edge in)."""
    return df.withColumn(out, bin_right_closed(c, RISK_EDGES, RISK_LABELS, True))


def cross_modal(df: DataFrame, completeness: Sequence[str], genetic: str | None = None, age: str | None = None,
                lifestyle: str | None = None, biomarker: str | None = None,
                imaging: Sequence[str] = ()) -> DataFrame:
    """Mean modality completeness; genetic risk x log1p(age, median
    filled); lifestyle x (1 - biomarker risk); mean of the imaging risks."""
    out = [row_mean(completeness).alias("multimodal_completeness")]
    if genetic and age:
        med = fit_stats(df, {age: ["median"]})[(age, "median")]
        out.append((F.col(genetic) * F.log1p(F.coalesce(F.col(age).cast("double"), lit_or_null(med)))).alias("genetic_age_interaction"))
    if lifestyle and biomarker:
        out.append((F.col(lifestyle) * (1 - F.col(biomarker))).alias("lifestyle_biomarker_interaction"))
    if imaging:
        out.append(row_mean(imaging).alias("neuroimaging_combined_risk"))
    return df.select("*", *out)


def completeness_score(df: DataFrame, completeness: str = "multimodal_completeness",
                       out: str = "composite_risk_score") -> DataFrame:
    """Fallback score 1 - completeness, with its category."""
    return risk_category(df.withColumn(out, 1 - F.col(completeness)), out)


def carrier_profile(df: DataFrame, carrier: str, target: str) -> DataFrame:
    """Target mean / std / count of non-carriers and carriers, the risk
    multiplier (carrier mean / non-carrier mean) and the high-risk threshold
    (carrier mean - carrier std); one row."""
    y = F.col(target).cast("double")
    c1, c0 = F.col(carrier) == 1, F.col(carrier) == 0
    p = df.agg(F.avg(F.when(c0, y)).alias("mean_non_carrier"), F.stddev_samp(F.when(c0, y)).alias("std_non_carrier"),
               F.count(F.when(c0, y)).alias("count_non_carrier"), F.avg(F.when(c1, y)).alias("mean_carrier"),
               F.stddev_samp(F.when(c1, y)).alias("std_carrier"), F.count(F.when(c1, y)).alias("count_carrier"))
    return p.select("*", F.try_divide(F.col("mean_carrier"), F.col("mean_non_carrier")).alias("risk_multiplier"),
                    (F.col("mean_carrier") - F.col("std_carrier")).alias("high_risk_threshold"))


def carrier_adjust(df: DataFrame, carrier: str, score: str, target: str | None = None) -> DataFrame:
    """Genetic stratum label and score x multiplier for carriers; the
    multiplier is fitted by R5 on ``target`` (default: the score)."""
    prof = carrier_profile(df, carrier, target or score).first()
    mult = prof["risk_multiplier"]
    return df.select("*", F.when(F.col(carrier) == 1, "High_Genetic_Risk").when(F.col(carrier) == 0, "Low_Genetic_Risk")
                     .alias("genetic_risk_stratum"),
                     F.when(F.col(carrier) == 1, F.col(score) * lit_or_null(mult)).otherwise(F.col(score)).alias("genetic_adjusted_risk"))


def hierarchical_stratum(df: DataFrame, category: str, carrier: str, biomarker: str | None = None,
                         q: float = 0.75) -> DataFrame:
    """Rules applied in order, a later rule overwriting an earlier one:
    High & carrier, High & non-carrier, Moderate & biomarker above its 75th
    percentile, Low & carrier; otherwise ``Other``.  Written as a CASE in
    reverse priority."""
    rules = [((F.col(category) == "High") & (F.col(carrier) == 1), "Critical_High_Risk_APOE4"),
             ((F.col(category) == "High") & (F.col(carrier) == 0), "High_Risk_Non_APOE4")]
    if biomarker:
        thr = fit_stats(df, {biomarker: [f"q{q}"]})[(biomarker, f"q{q}")]
        rules.append(((F.col(category) == "Moderate") & (F.col(biomarker) > lit_or_null(thr)), "Moderate_Risk_High_Biomarkers"))
    rules.append(((F.col(category) == "Low") & (F.col(carrier) == 1), "Low_Risk_APOE4_Carrier"))
    expr = None
    for cond, label in reversed(rules):
        cond = F.coalesce(cond, F.lit(False))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return df.withColumn("hierarchical_stratum", expr.otherwise("Other"))


def threshold_stratum(df: DataFrame, c: str, lo: float = 0.33, hi: float = 0.67,
                      fit_on: Sequence[str] | None = None) -> DataFrame:
    """Thresholds at the 33rd / 67th percentiles (fitted on rows where the
    ``fit_on`` columns are all present); default Moderate, <= low -> Low,
    >= high -> High."""
    fit_df = df.dropna(subset=list(fit_on)) if fit_on else df
    st = fit_stats(fit_df, {c: [f"q{lo}", f"q{hi}"]})
    tl, th = lit_or_null(st[(c, f"q{lo}")]), lit_or_null(st[(c, f"q{hi}")])
    return df.withColumn("biomarker_stratum", F.when(F.col(c) >= th, "High_Biomarker_Risk")
                         .when(F.col(c) <= tl, "Low_Biomarker_Risk").otherwise("Moderate_Biomarker_Risk"))


def cluster_stratum(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 42, starts: int = 10) -> DataFrame:
    """K-means (best of ``starts``) on the complete rows with k chosen by silhouette; clusters
    are renumbered by the mean of their first feature, and the three lowest
    get Low / Moderate / High (the reference labels three clusters only)."""
    from pyspark.ml.feature import VectorAssembler

    data = cut_lineage(VectorAssembler(inputCols=list(cols), outputCol="_f").transform(df.dropna(subset=list(cols))))
    fitted = fit_kmeans(data, list(ks), starts, "_f", "_c", seed)
    model = max(fitted, key=lambda m: float("-inf") if m[2] is None else m[2])[0]
    pred = model.transform(data)
    centers = sorted(range(len(model.centres)), key=lambda i: model.centres[i][0]) or [0]
    order = {c: r for r, c in enumerate(centers)}
    rank = F.element_at(F.create_map(*[x for c, r in order.items() for x in (F.lit(c), F.lit(r))]), F.col("_c"))
    labels = F.element_at(F.create_map(F.lit(0), F.lit("Low_Biomarker_Risk"), F.lit(1), F.lit("Moderate_Biomarker_Risk"),
                                       F.lit(2), F.lit("High_Biomarker_Risk")), rank)
    return pred.select(*df.columns, rank.alias("biomarker_cluster"), labels.alias("biomarker_stratum"))


def combined_stratum(df: DataFrame, category: str = "risk_category") -> DataFrame:
    """Critical_Multi_Risk when (high genetic stratum and critical
    hierarchical stratum) or (high biomarker stratum and High category),
    else Standard_Risk."""
    c1 = (F.col("genetic_risk_stratum") == "High_Genetic_Risk") & (F.col("hierarchical_stratum") == "Critical_High_Risk_APOE4")
    c2 = (F.col("biomarker_stratum") == "High_Biomarker_Risk") & (F.col(category) == "High")
    return df.withColumn("comprehensive_stratum",
                         F.when(F.coalesce(c1, F.lit(False)) | F.coalesce(c2, F.lit(False)), "Critical_Multi_Risk")
                         .otherwise("Standard_Risk"))


def stratum_metrics(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Samples, overall completeness, and per stratum column the number
    of strata and each stratum's share; long (metric, value)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 (sum((F.count(F.col(c)) for c in cols), F.lit(0)) / (F.count(F.lit(1)) * len(cols))).alias("comp"),
                 *[F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(strata)])
    base = row.select(F.explode(F.array(
        F.struct(F.lit("total_samples").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("stratification_completeness").alias("metric"), F.col("comp").cast("double").alias("value")),
        *[F.struct(F.lit(f"{c}_unique_strata").alias("metric"), F.col(f"u{i}").cast("double").alias("value"))
          for i, c in enumerate(strata)])).alias("e")).select("e.*")
    parts = [base]
    for c in strata:
        vc = value_counts(df, c)
        parts.append(vc.select(F.concat(F.lit(f"{c}_"), F.col(c).cast("string"), F.lit("_proportion")).alias("metric"),
                               F.col("proportion").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def consensus_stratum(df: DataFrame, cols: Sequence[str], out: str = "consensus_stratum") -> DataFrame:
    """Most frequent label across the stratification columns of a row
    (ties -> the label appearing first in column order)."""
    labels = F.array(*[F.col(c).cast("string") for c in cols])
    present = F.filter(labels, lambda x: x.isNotNull())
    scored = F.transform(present, lambda x, i: F.struct(
        F.size(F.filter(present, lambda y: y == x)).alias("n"), (-i).alias("neg_pos"), x.alias("label")))
    return df.withColumn(out, F.when(F.size(present) > 0, F.array_max(scored)["label"]))
