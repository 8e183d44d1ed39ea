"""Longitudinal analysis.

Per-subject loops of the reference become windows (ordered work) or
``groupBy`` aggregates (moments, slopes).  Only the change-point dynamic
program (G7) runs per subject in pandas; the kernel sums of long series are
made by many tasks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.nulls import clip, safe_div
from ..functions.stats import fit_stats, pair_corr, t_pvalue
from ..session import cut_lineage
from .tiled_pelt import pelt_from_strips, strip_sums, tile_size
from .windows import _as_list, subject_window


def annualised_change(df: DataFrame, key, order, date: str, y: str, prefix: str | None = None,
                      lo_q: float = 0.05, hi_q: float = 0.95, materialize: bool = True) -> DataFrame:
    """G1: days since baseline, change since the previous visit and the change
    annualised by the days between the two visits (``d * 365.25 / days``,
    zero days -> null), plus both changes clipped to the 5th / 95th
    percentile of the whole column.  Subjects with a single visit get nulls."""
    p = prefix or y
    w = subject_window(key, order)
    wall = Window.partitionBy(*_as_list(key))
    first_date = F.first(date).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    multi = F.count(F.lit(1)).over(wall) > 1
    prev_y, prev_d = F.lag(y).over(w), F.lag(date).over(w)
    change = F.col(y).cast("double") - prev_y.cast("double")
    out = df.select(
        "*",
        F.when(multi, F.datediff(F.col(date), first_date)).alias("days_since_baseline"),
        F.when(multi, change).alias(f"{p}_change"),
        F.when(multi, safe_div(change * 365.25, F.datediff(F.col(date), prev_d))).alias(f"{p}_change_annual"),
    )
    if materialize:
        # the windowed table feeds the quantile fit and the final projection:
        # write it once (reliable checkpoint) instead of re-sorting it per action
        out = cut_lineage(out)
    return winsorize_columns(out, [f"{p}_change", f"{p}_change_annual"], lo_q, hi_q)


def winsorize_columns(df: DataFrame, cols: Sequence[str], lo_q: float = 0.05, hi_q: float = 0.95,
                      suffix: str = "_winsorized") -> DataFrame:
    """Clip each column to its own exact quantiles (one aggregate job)."""
    st = fit_stats(df, {c: [f"q{lo_q}", f"q{hi_q}"] for c in cols})
    return df.select("*", *[clip(c, st[(c, f"q{lo_q}")], st[(c, f"q{hi_q}")]).alias(f"{c}{suffix}")
                            for c in cols])


def transitions(df: DataFrame, key, order, date: str, ordinal: str, prefix: str = "diagnosis") -> DataFrame:
    """Previous ordinal, transition (difference) and days since the
    previous visit where a previous ordinal exists."""
    w = subject_window(key, order)
    prev = F.lag(ordinal).over(w)
    prev_d = F.lag(date).over(w)
    return df.select("*", prev.alias(f"{prefix}_prev"),
                     (F.col(ordinal) - prev).alias(f"{prefix}_transition"),
                     F.when(prev.isNotNull(), F.datediff(F.col(date), prev_d)).alias("days_to_transition"))


def subject_slope(df: DataFrame, key, t: str, y: str, min_n: int = 3, out: str = "overall_slope") -> DataFrame:
    """OLS slope of y on t per subject with at least ``min_n`` visits,
    attached to every row (aggregate + join, no window)."""
    keys = _as_list(key)
    s = (df.groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("_n"), F.regr_slope(F.col(y).cast("double"), F.col(t).cast("double")).alias("_s"))
         .select(*keys, F.when(F.col("_n") >= min_n, F.col("_s")).alias(out)))
    return df.join(s, keys, "left")


def trend_moments(df: DataFrame, key, order, t: str, y: str) -> DataFrame:
    """Per-subject moments behind G4: OLS slope and its t statistic, the
    pooled two-sample t statistic of the first floor(n/2) visits against the
    rest, and the quadratic coefficient (x100) of a least-squares parabola
    from the closed-form normal equations."""
    keys = _as_list(key)
    w = subject_window(key, order)
    # time centred per subject keeps the normal equations well conditioned
    tc = F.col(t).cast("double") - F.avg(F.col(t).cast("double")).over(Window.partitionBy(*keys))
    x = (df.select(*keys, tc.alias("t"), F.col(y).cast("double").alias("y"),
                   F.row_number().over(w).alias("_pos"),
                   F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_cnt"))
         .withColumn("_h", (F.col("_pos") > F.floor(F.col("_cnt") / 2)).cast("int")))
    t_, y_ = F.col("t"), F.col("y")
    first, second = F.col("_h") == 0, F.col("_h") == 1
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(t_).alias("_nt"),
        F.min(t_).alias("t_min"), F.max(t_).alias("t_max"),
        F.regr_slope(y_, t_).alias("slope"),
        pair_corr(y_, t_).alias("r"),
        F.var_pop(y_).alias("_vy"),
        F.count(F.when(first, y_)).alias("n1"), F.count(F.when(second, y_)).alias("n2"),
        F.avg(F.when(first, y_)).alias("m1"), F.avg(F.when(second, y_)).alias("m2"),
        F.var_samp(F.when(first, y_)).alias("v1"), F.var_samp(F.when(second, y_)).alias("v2"),
        *[F.sum(F.pow(t_, k)).alias(f"_s{k}") for k in range(1, 5)],
        F.sum(y_).alias("_sy"), F.sum(t_ * y_).alias("_sty"), F.sum(t_ * t_ * y_).alias("_st2y"),
    )
    n = F.col("n").cast("double")
    # r = 0 for a constant series (no linear association), then the t statistic
    r = F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(F.col("r"))
    tiny = 1e-20
    t_slope = r * F.sqrt((n - 2) / ((1.0 - r + tiny) * (1.0 + r + tiny)))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    t_half = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1.0 / F.col("n1") + 1.0 / F.col("n2"))))
    # normal equations [[n,s1,s2],[s1,s2,s3],[s2,s3,s4]] [c,b,a] = [sy,sty,st2y]
    s0, s1, s2, s3, s4 = n, F.col("_s1"), F.col("_s2"), F.col("_s3"), F.col("_s4")
    sy, sty, st2y = F.col("_sy"), F.col("_sty"), F.col("_st2y")
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    det_a = s0 * (s2 * st2y - sty * s3) - s1 * (s1 * st2y - sty * s2) + sy * (s1 * s3 - s2 * s2)
    # a parabola needs three distinct time points; otherwise det is 0 up to noise
    curvature = F.when(F.col("_nt") >= 3, F.try_divide(det_a, det) * 100.0)
    return g.select(*keys, "n", "slope", t_slope.alias("t_slope"), (n - 2).alias("df_slope"),
                    "n1", "n2", "m1", "m2", t_half.alias("t_half"),
                    (F.col("n1") + F.col("n2") - 2).alias("df_half"),
                    curvature.alias("curvature"), "t_min", "t_max")


def classify_trend(df: DataFrame, key, order, t: str, y: str, p_slope: float = 0.05,
                   min_slope: float = 0.03, p_half: float = 0.1, min_shift: float = 0.05,
                   min_curv: float = 0.5) -> DataFrame:
    """Trend class per subject.  Significant OLS slope (p < 0.05) with
    |slope| > 0.03; else a half-means shift (pooled t-test p < 0.1) above
    0.05; else |curvature| > 0.5 -> nonlinear; short series give
    ``insufficient_data`` and a constant time axis ``constant_time``."""
    m = trend_moments(df, key, order, t, y)
    m = (m.withColumn("p_value", F.when(F.col("n") >= 3, t_pvalue(F.col("t_slope"), F.col("df_slope"))))
         .withColumn("p_half", F.when((F.col("n1") > 1) & (F.col("n2") > 1),
                                      t_pvalue(F.col("t_half"), F.col("df_half")))))
    slope, ph = F.col("slope"), F.coalesce(F.col("p_half"), F.lit(1.0))
    sig = F.col("p_value") < p_slope
    shift = F.col("m2") - F.col("m1")
    pattern = (F.when(F.col("n") < 3, "insufficient_data")
               .when(F.col("t_min") == F.col("t_max"), "constant_time")
               .when(sig & (slope > min_slope), "progressive")
               .when(sig & (slope < -min_slope), "improving")
               .when(sig, "stable")
               .when((ph < p_half) & (shift > min_shift), "progressive")
               .when((ph < p_half) & (shift < -min_shift), "improving")
               .when(ph < p_half, "stable")
               .when(F.abs(F.coalesce(F.col("curvature"), F.lit(0.0))) > min_curv, "nonlinear")
               .otherwise("stable"))
    keys = _as_list(key)
    return m.select(*keys, "n", "slope", "p_value", "t_half", "p_half", "curvature", pattern.alias("pattern"))


def progression_pattern(df: DataFrame, key, order, y: str, delta: float = 0.1) -> DataFrame:
    """Per subject with >= 2 visits, first and last value in time order,
    total change and its class (progressive / improving / stable)."""
    keys = _as_list(key)
    ordkey = F.struct(*[F.col(o) for o in _as_list(order)])
    s = (df.groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("n_visits"),
              F.min_by(F.col(y).cast("double"), ordkey).alias("initial_value"),
              F.max_by(F.col(y).cast("double"), ordkey).alias("final_value"))
         .where(F.col("n_visits") >= 2)
         .withColumn("total_change", F.col("final_value") - F.col("initial_value")))
    return s.withColumn("pattern", F.when(F.col("total_change") > delta, "progressive")
                        .when(F.col("total_change") < -delta, "improving").otherwise("stable"))


def pattern_distribution(patterns: DataFrame, pattern: str = "pattern", change: str = "total_change") -> DataFrame:
    """G5 summary: subjects per class, share and mean change per class."""
    w = Window.partitionBy()
    return (patterns.groupBy(pattern)
            .agg(F.count(F.lit(1)).alias("n_subjects"), F.avg(change).alias("mean_change"))
            .withColumn("share", F.col("n_subjects") / F.sum("n_subjects").over(w)))


def gap_guarded_change(df: DataFrame, key, order, days: str, y: str, min_gap: float = 90,
                       out: str | None = None) -> DataFrame:
    """Change since the previous visit only where the gap is >= min_gap."""
    w = subject_window(key, order)
    gap = F.col(days) - F.lag(days).over(w)
    return df.withColumn(out or f"{y}_change_safe",
                         F.when(gap >= min_gap, F.col(y) - F.lag(y).over(w)))


# ---------------------------------------------------------------------------
# G7 change points: PELT with an RBF kernel cost on min-max normalised series.

#: points of a series whose pairs are listed at once
ALL_PAIRS = 500


def median_squared_distance(x: np.ndarray) -> float:
    """Median of (x_i - x_j)^2 over all pairs.  Up to ALL_PAIRS points the
    pairs are listed; for more, in memory linear in ``x``, the value at a rank
    is found by bisection over the bits of doubles, with the pairs up to a
    value counted by binary searches in the sorted series.  Both give the same."""
    x = np.sort(np.asarray(x, dtype=float))
    n, pairs = len(x), len(x) * (len(x) - 1) // 2
    if not pairs:
        return 0.0
    if n <= ALL_PAIRS:
        d = np.concatenate([x[i:] - x[:-i] for i in range(1, n)])
        d = np.partition(d * d, [(pairs - 1) // 2, pairs // 2])
        return float(d[pairs // 2]) if pairs % 2 else float(d[(pairs - 1) // 2] + d[pairs // 2]) / 2
    first = np.arange(n)

    def up_to(limit: float) -> int:
        low, high = first.copy(), np.full(n, n - 1)      # last j with (x_j - x_i)^2 <= limit
        while (low < high).any():
            mid = (low + high + 1) // 2
            near = (x[mid] - x) ** 2 <= limit
            low, high = np.where(near, mid, low), np.where(near, high, mid - 1)
        return int((low - first).sum())

    def at_rank(k: int) -> float:
        low, high = 0, int(np.float64((x[-1] - x[0]) ** 2).view(np.int64))
        while low < high:
            mid = (low + high) // 2
            if up_to(float(np.int64(mid).view(np.float64))) > k:
                high = mid
            else:
                low = mid + 1
        return float(np.int64(low).view(np.float64))

    lower = at_rank((pairs - 1) // 2)
    return lower if pairs % 2 else (lower + at_rank(pairs // 2)) / 2


def pelt_rbf(x: np.ndarray, penalty: float = 2.0, min_size: int = 2) -> list[int]:
    """Exact PELT (pruned optimal partitioning) with the kernel cost
    c(a, b) = sum_i K_ii - sum_{i,j in [a,b)} K_ij / (b - a), where
    K_ij = exp(-gamma d^2), gamma = 1 / median(d^2) and the scaled distances
    are clipped to [1e-2, 1e2].  Returns segment ends, the last one being
    ``len(x)``.

    Memory is linear: only the kernel sums of the segments that end at the
    current point are kept, and each new point adds its own column to them.
    """
    x = np.asarray(x, dtype=float)
    n = len(x)
    med = median_squared_distance(x)
    gamma = 1.0 / med if med != 0 else 1.0
    sums = np.zeros(n + 1)                               # of K over [a, end) x [a, end)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    admissible = np.empty(0, int)
    for end in range(1, n + 1):
        new = end - 1
        column = np.exp(-np.clip((x[:new] - x[new]) ** 2 * gamma, 1e-2, 1e2))
        sums[:new] += 2 * np.cumsum(column[::-1])[::-1] + 1
        sums[new] = 1.0
        if end < min_size:
            continue
        admissible = np.append(admissible, end - min_size)
        admissible = admissible[np.isfinite(best[admissible])]
        if not len(admissible):
            continue
        size = end - admissible
        scored = best[admissible] + size - sums[admissible] / size + penalty
        pick = int(scored.argmin())
        best[end], back[end] = scored[pick], admissible[pick]
        admissible = admissible[scored <= scored[pick] + penalty]
    if not np.isfinite(best[n]) or n == 0:
        return [n]
    ends = [n]
    while back[ends[-1]] > 0:
        ends.append(int(back[ends[-1]]))
    return ends[::-1]


CP_SCHEMA = T.StructType([T.StructField("subject", T.StringType()), T.StructField("n_points", T.IntegerType()),
                          T.StructField("n_change_points", T.IntegerType()),
                          T.StructField("change_points", T.ArrayType(T.IntegerType()))])


def _series(batches):
    """(subjects, values, where each begins) of whole series from batches (k,
    y) in which a series' rows follow each other."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        k = held.column("k")
        new = pc.not_equal(k.slice(1), k.slice(0, max(len(k) - 1, 0)))
        if pa.types.is_floating(k.type):
            new = pc.and_(new, pc.invert(pc.and_(pc.is_nan(k.slice(1)), pc.is_nan(k.slice(0, max(len(k) - 1, 0))))))
        cuts = np.flatnonzero(new.to_numpy()) + 1
        if len(cuts):
            whole, held = held.slice(0, int(cuts[-1])), held.slice(int(cuts[-1]))
            starts = np.append(0, cuts[:-1])
            yield whole.column("k").take(pa.array(starts)).to_pylist(), whole.column("y").to_numpy(), np.append(starts, len(whole))
    if held is not None and len(held):
        yield held.column("k").slice(0, 1).to_pylist(), held.column("y").to_numpy(), np.array([0, len(held)])


def change_points(df: DataFrame, key: str, order, y: str, min_points: int = 5, penalty: float = 2.0,
                  min_size: int = 2, tile_from: int = 10_000) -> DataFrame:
    """Change points per subject with >= ``min_points`` non-null values:
    min-max normalise (``(v - min) / (max - min + 1e-8)``), PELT with the RBF
    cost, keep breakpoints strictly inside ``(0, n - 1)``.

    Series of fewer than ``tile_from`` points are sorted within tasks, which
    take one after the other from their batches.  The kernel sums of longer ones are made by many tasks (``tiled_pelt``), and only the
    recursion over them is one call, with memory linear in the series (up to
    1,600 bytes a point; 5 million points at most, an Arrow column's limit).
    Both give the same change points.  Rows without a subject are no series.
    """
    order = _as_list(order)
    by = [f"o{i}" for i in range(len(order))]
    vals = (df.where(F.col(y).isNotNull() & F.col(key).isNotNull())
            .select(F.col(key).alias("k"), *[F.col(o).alias(a) for o, a in zip(order, by)], F.col(y).cast("double").alias("y")))
    long = vals.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(tile_from, min_points)).select("k")

    def scaled(v: np.ndarray) -> np.ndarray:
        return (v - v.min()) / (v.max() - v.min() + 1e-8)

    def values(pdf: pd.DataFrame) -> np.ndarray:
        return scaled(pdf.sort_values(by)["y"].to_numpy(dtype=float))

    def row(subject, n: int, ends: list[int]) -> pd.DataFrame:
        cps = [c for c in ends if 0 < c < n - 1]
        return pd.DataFrame({"subject": [str(subject)], "n_points": [n], "n_change_points": [len(cps)], "change_points": [cps]})

    def run(batches):
        for subjects, y_, cuts in _series(batches):
            out = []
            for k, i, j in zip(subjects, cuts[:-1].tolist(), cuts[1:].tolist()):
                if j - i >= min_points:
                    cps = [c for c in pelt_rbf(scaled(y_[i:j]), penalty, min_size) if 0 < c < j - i - 1]
                    out.append((str(k), j - i, len(cps), cps))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    types, spread = to_arrow_schema(CP_SCHEMA), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one_by_one(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(spread, "k").sortWithinPartitions("k", *[F.asc_nulls_last(a) for a in by], "y")
        return rows.select("k", "y").mapInArrow(run, CP_SCHEMA)

    if long.isEmpty():
        return one_by_one(vals)

    def written(pdf: pd.DataFrame) -> pd.DataFrame:
        v = values(pdf)
        med = median_squared_distance(v)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "tiles": [-(-len(v) // tile_size(len(v)))],
                             "gamma": [1.0 / med if med != 0 else 1.0], "x": [v.tobytes()]})

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        got = strip_sums(np.frombuffer(one["x"]), one["gamma"], int(one["tile"]))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "tile": [int(one["tile"])], "strip": [got.tobytes()]})

    def walk(series: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        x, gamma = np.frombuffer(series["x"].iloc[0]), float(series["gamma"].iloc[0])
        size, parts = tile_size(len(x)), parts.sort_values("tile")
        strips = (np.frombuffer(s).reshape(len(x[t * size:(t + 1) * size]), t) for t, s in zip(parts["tile"], parts["strip"]))
        return row(series["k"].iloc[0], len(x), pelt_from_strips(x, gamma, strips, penalty, min_size))

    kind = T.StructField("k", vals.schema["k"].dataType)
    whole = T.StructType([kind, T.StructField("tiles", T.IntegerType()), T.StructField("gamma", T.DoubleType()), T.StructField("x", T.BinaryType())])
    piece = T.StructType([kind, T.StructField("tile", T.IntegerType()), T.StructField("strip", T.BinaryType())])
    series = cut_lineage(vals.join(long, "k", "left_semi").repartition(spread, "k").groupBy("k").applyInPandas(written, whole))
    strips = (series.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .repartition(spread, "k", "tile").groupBy("k", "tile").applyInPandas(strip, piece))     # a task per tile, whatever their bytes
    short = one_by_one(vals.join(long, "k", "left_anti"))
    return short.unionByName(series.groupBy("k").cogroup(strips.groupBy("k")).applyInPandas(walk, CP_SCHEMA))


def change_point_summary(cp: DataFrame) -> DataFrame:
    """Subjects analysed, subjects with a change point, and mean / max
    change points over the subjects that have one."""
    has = F.col("n_change_points") > 0
    return cp.agg(F.count(F.lit(1)).alias("subjects"),
                  F.count_if(has).alias("subjects_with_change"),
                  F.avg(F.when(has, F.col("n_change_points"))).alias("mean_change_points"),
                  F.max(F.when(has, F.col("n_change_points"))).alias("max_change_points"))


def temporal_summary(df: DataFrame, key: str, t: str) -> DataFrame:
    """Observations, subjects, visits per subject (mean / min / max), range of t."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_v"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    return per.agg(F.sum("_v").alias("observations"), F.count(F.lit(1)).alias("subjects"),
                   F.avg("_v").alias("visits_mean"), F.min("_v").alias("visits_min"),
                   F.max("_v").alias("visits_max"), F.min("_lo").alias("t_min"), F.max("_hi").alias("t_max"))


def score_horizons(last: DataFrame, t: str, months: Sequence[int] = (6, 12, 24)) -> DataFrame:
    """One row per (last visit, horizon) with the future time point; the
    horizon list is a fixed literal array exploded per row (no join)."""
    return (last.withColumn("horizon_months", F.explode(F.array(*[F.lit(int(m)) for m in months])))
            .withColumn("future_t", F.col(t) + F.col("horizon_months")))


def date_conflicts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two dates are both present and differ."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
