"""Scaling, outlier handling and encodings.

Each operator is fit / transform: one aggregate job computes every
statistic it needs for all columns at once (``fit_stats``), then a single
projection applies them as literals, so the transform stays inside one
whole-stage-codegen span.  Standard deviations follow the reference: the
standard scaler uses the population std, z-scores the sample std.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import clip, flag, safe_div
from ..functions.stats import fit_stats, global_row_number, lit_or_null


def _lit(v) -> Column:
    return lit_or_null(v)


def scale_standard(df: DataFrame, cols: Sequence[str], ddof: int = 0, suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / std with population std (``ddof=0``); zero std -> null."""
    sd = "std_pop" if ddof == 0 else "std"
    st = fit_stats(df, {c: ["mean", sd] for c in cols})
    return df.select("*", *[safe_div(F.col(c) - _lit(st[(c, "mean")]), _lit(st[(c, sd)])).alias(f"{c}{suffix}")
                            for c in cols])


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_zscore") -> DataFrame:
    """Z-score with the sample std; zero std -> null."""
    st = fit_stats(df, {c: ["mean", "std"] for c in cols})
    return df.select("*", *[safe_div(F.col(c) - _lit(st[(c, "mean")]), _lit(st[(c, "std")])).alias(f"{c}{suffix}")
                            for c in cols])


def zscore_exprs(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """z-score expressions (sample std) for use inside larger projections."""
    st = fit_stats(df, {c: ["mean", "std"] for c in cols})
    return {c: safe_div(F.col(c) - _lit(st[(c, "mean")]), _lit(st[(c, "std")])) for c in cols}


def scale_minmax(df: DataFrame, cols: Sequence[str], eps: float = 0.0, suffix: str = "_minmax") -> DataFrame:
    """(x - min) / (max - min + eps); a zero range without eps -> null."""
    st = fit_stats(df, {c: ["min", "max"] for c in cols})
    out = []
    for c in cols:
        lo, hi = _lit(st[(c, "min")]), _lit(st[(c, "max")])
        out.append(safe_div(F.col(c) - lo, hi - lo + F.lit(eps)).alias(f"{c}{suffix}"))
    return df.select("*", *out)


def scale_robust(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - median) / IQR into new columns; an IQR of 0 divides by 1."""
    st = fit_stats(df, {c: ["median", "q0.25", "q0.75"] for c in cols})
    out = []
    for c in cols:
        iqr = (st[(c, "q0.75")] or 0.0) - (st[(c, "q0.25")] or 0.0)
        out.append(((F.col(c) - _lit(st[(c, "median")])) / F.lit(iqr if iqr != 0 else 1.0)).alias(f"{c}{suffix}"))
    return df.select("*", *out)


def normal_flag(df: DataFrame, cols: Sequence[str], z: float = 2.0, suffix: str = "_normal") -> DataFrame:
    """1 when |population z-score| <= 2 (missing -> 0)."""
    st = fit_stats(df, {c: ["mean", "std_pop"] for c in cols})
    return df.select("*", *[flag(F.abs(safe_div(F.col(c) - _lit(st[(c, "mean")]), _lit(st[(c, "std_pop")]))) <= z)
                            .alias(f"{c}{suffix}") for c in cols])


def winsorize_quantile(df: DataFrame, cols: Sequence[str], lo_q: float = 0.05, hi_q: float = 0.95,
                       suffix: str = "") -> DataFrame:
    """Clip each column to its own exact lo / hi quantiles (null stays null)."""
    st = fit_stats(df, {c: [f"q{lo_q}", f"q{hi_q}"] for c in cols})
    repl = {c: clip(c, st[(c, f"q{lo_q}")], st[(c, f"q{hi_q}")]) for c in cols}
    if suffix:
        return df.select("*", *[e.alias(f"{c}{suffix}") for c, e in repl.items()])
    return df.select([repl[c].alias(c) if c in repl else F.col(c) for c in df.columns])


def winsorize_iqr(df: DataFrame, c: str, k: float = 1.5, log_eps: float = 1e-10) -> DataFrame:
    """Values below Q1 - k IQR become p5, above Q3 + k IQR become p95
    (of the whole column); then ``log1p(x + eps)``."""
    st = fit_stats(df, {c: ["q0.25", "q0.75", "q0.05", "q0.95"]})
    q1, q3 = st[(c, "q0.25")], st[(c, "q0.75")]
    if q1 is None:
        w = F.col(c)
    else:
        iqr = q3 - q1
        w = (F.when(F.col(c) < q1 - k * iqr, _lit(st[(c, "q0.05")]))
             .when(F.col(c) > q3 + k * iqr, _lit(st[(c, "q0.95")])).otherwise(F.col(c).cast("double")))
    return df.select("*", w.alias(f"{c}_winsorized"), F.log1p(w + F.lit(log_eps)).alias(f"{c}_log"))


def flag_iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5, suffix: str = "_outlier",
                      count_col: str | None = "outlier_count") -> DataFrame:
    """1 when outside [Q1 - k IQR, Q3 + k IQR] (missing -> 0), plus the
    number of flagged columns per row."""
    st = fit_stats(df, {c: ["q0.25", "q0.75"] for c in cols})
    flags = {}
    for c in cols:
        q1, q3 = st[(c, "q0.25")], st[(c, "q0.75")]
        if q1 is None:
            flags[c] = F.lit(0)
        else:
            iqr = q3 - q1
            flags[c] = flag((F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr))
    out = df.select("*", *[e.alias(f"{c}{suffix}") for c, e in flags.items()])
    if count_col:
        out = out.withColumn(count_col, sum((F.col(f"{c}{suffix}") for c in cols), F.lit(0)))
    return out


def flag_sd_anomalies(df: DataFrame, key: str, high: Sequence[str] = (), low: Sequence[str] = (),
                      n_sd: float = 2.0, total_col: str = "total_anomalies") -> DataFrame:
    """``x > mean + 2 sd`` for ``high`` columns, ``x < mean - 2 sd`` for
    ``low`` columns (sample sd), any-of flag and its per-subject count
    (aggregate + join)."""
    cols = list(high) + list(low)
    st = fit_stats(df, {c: ["mean", "std"] for c in cols})
    flags = {}
    for c in high:
        flags[c] = flag(F.col(c) > _lit(st[(c, "mean")]) + n_sd * _lit(st[(c, "std")]))
    for c in low:
        flags[c] = flag(F.col(c) < _lit(st[(c, "mean")]) - n_sd * _lit(st[(c, "std")]))
    out = df.select("*", *[e.alias(f"anomalous_{c}") for c, e in flags.items()])
    out = out.withColumn("any_anomaly", F.greatest(*[F.col(f"anomalous_{c}") for c in cols]) if len(cols) > 1
                         else F.col(f"anomalous_{cols[0]}"))
    per = out.groupBy(key).agg(F.sum("any_anomaly").alias(total_col))
    return out.join(per, key, "left")


def log_if_skewed(df: DataFrame, cols: Sequence[str], threshold: float = 1.0, suffix: str = "_log") -> tuple[DataFrame, list[str]]:
    """``log1p`` of every column whose minimum is > 0 and whose
    bias-corrected |skewness| exceeds the threshold.  Returns the frame and
    the transformed column names."""
    st = fit_stats(df, {c: ["min", "skew"] for c in cols})
    chosen = [c for c in cols if st[(c, "min")] is not None and st[(c, "min")] > 0
              and st[(c, "skew")] is not None and abs(st[(c, "skew")]) > threshold]
    return df.select("*", *[F.log1p(F.col(c)).alias(f"{c}{suffix}") for c in chosen]), chosen


def flag_quantile(df: DataFrame, c: str, q: float, side: str = "low", inclusive: bool = True,
                  out: str | None = None) -> DataFrame:
    """Flag values at or below (``low``) / above (``high``) the exact
    q-quantile of the column (missing -> 0)."""
    v = fit_stats(df, {c: [f"q{q}"]})[(c, f"q{q}")]
    thr = _lit(v)
    if side == "low":
        cond = F.col(c) <= thr if inclusive else F.col(c) < thr
    else:
        cond = F.col(c) >= thr if inclusive else F.col(c) > thr
    return df.withColumn(out or f"{c}_{side}_q{int(q * 100)}", flag(cond))


def label_encode(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Code 0..k-1 of the distinct values in their order (null stays
    null).  The distinct values are numbered where they are and joined back,
    so their number does not matter."""
    labels = df.select(F.col(c).alias("_label")).where(F.col("_label").isNotNull()).distinct()
    codes = global_row_number(labels, [], ["_label"], "_code").select("_label", (F.col("_code") - 1).cast("int").alias("_code"))
    name = out or f"{c}_code"
    kept = [F.col(x) for x in df.columns if x != name]
    return df.join(codes, F.col(c) == F.col("_label"), "left").select(*kept, F.col("_code").alias(name))

