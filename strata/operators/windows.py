"""Window and ranking operators.

Ordered per-subject work uses ``Window.partitionBy(key).orderBy(order)``;
every order gets an explicit tie-break column so results do not depend on
partitioning.  Unordered per-group statistics are computed with a
``groupBy`` (partial aggregation, so a hot key is pre-aggregated map-side)
and joined back, which lets AQE split a skewed join partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from ..functions.stats import group_quantiles
from ..functions.stats import rank_pct as _rank_pct


def _as_list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def subject_window(key, order, desc: bool = False):
    cols = [F.col(o).desc() if desc else F.col(o).asc() for o in _as_list(order)]
    return Window.partitionBy(*_as_list(key)).orderBy(*cols)


def lag_per_subject(df: DataFrame, key, order, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Previous value of each column per subject."""
    w = subject_window(key, order)
    return df.select("*", *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in cols])


def rate_of_change(df: DataFrame, key, order, t: str, y: str, out: str = "rate_of_change") -> DataFrame:
    """(y - prev y) / (t - prev t); a zero time step gives null."""
    w = subject_window(key, order)
    return df.withColumn(out, safe_div(F.col(y) - F.lag(y).over(w), F.col(t) - F.lag(t).over(w)))


def baseline_change(df: DataFrame, key, order, y: str, date: str | None = None,
                    single_visit: str = "null") -> DataFrame:
    """Baseline value, change from baseline and (optionally) days since
    the baseline date.  ``single_visit='null'`` leaves subjects with one visit
    null, ``'drop'`` removes them."""
    w = subject_window(key, order)
    wall = Window.partitionBy(*_as_list(key))
    n = F.count(F.lit(1)).over(wall)
    first = F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = df.withColumn("_n_visits", n)
    out = out.withColumn("baseline_value", F.when(F.col("_n_visits") > 1, first))
    out = out.withColumn("change_from_baseline", F.col(y) - F.col("baseline_value"))
    if date:
        fd = F.first(date).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("days_since_baseline",
                             F.when(F.col("_n_visits") > 1, F.datediff(F.col(date), fd)))
    if single_visit == "drop":
        out = out.where(F.col("_n_visits") > 1)
    return out.drop("_n_visits")


def subject_extrema(df: DataFrame, key, y: str) -> DataFrame:
    """Per-subject max, min, sample std of ``y`` attached to rows
    (std of a single visit is null)."""
    keys = _as_list(key)
    stats = df.groupBy(*keys).agg(F.max(y).alias("max_value"), F.min(y).alias("min_value"),
                                  F.stddev_samp(y).alias("variability"))
    return df.join(stats, keys, "left")


def rolling_mean(df: DataFrame, key, order, y: str, n: int = 3, min_n: int = 2,
                 out: str | None = None) -> DataFrame:
    """Trailing mean over ``n`` rows with at least ``min_n`` non-null."""
    w = subject_window(key, order).rowsBetween(-(n - 1), 0)
    out = out or f"{y}_rolling{n}"
    return df.withColumn(out, F.when(F.count(y).over(w) >= min_n, F.avg(y).over(w)))


def rank_pct(df: DataFrame, col: str, out: str | None = None, ascending: bool = True) -> DataFrame:
    """Average-tie percentile rank over non-null values."""
    return _rank_pct(df, col, out or f"{col}_pct", ascending)


def first_non_null(df: DataFrame, key, order, cols: Sequence[str] | None = None,
                   latest: bool = False) -> DataFrame:
    """Per key, the first (or latest) non-null value of every column
    in the given order.  ``order`` must end in a unique tie-break."""
    keys = _as_list(key)
    order = _as_list(order)
    cols = [c for c in (cols or df.columns) if c not in keys]
    ordkey = F.struct(*[F.col(o) for o in order])
    pick = F.max_by if latest else F.min_by
    aggs = [pick(F.col(c), F.when(F.col(c).isNotNull(), ordkey)).alias(c) for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def last_visit(df: DataFrame, key, order) -> DataFrame:
    """Last row per subject (whole row)."""
    w = subject_window(key, order, desc=True)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fill_group_median(df: DataFrame, group, y: str, out: str | None = None) -> DataFrame:
    """Fill nulls of ``y`` with the exact median of its group."""
    keys = _as_list(group)
    med = group_quantiles(df, keys, y, [0.5], ["_med"])
    return (df.join(med, keys, "left")
            .withColumn(out or y, F.coalesce(F.col(y).cast("double"), F.col("_med")))
            .drop("_med"))


def flag_duplicates(df: DataFrame, keys: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """1 for every member of a key group with more than one row
    (null keys form their own group, as in pandas ``duplicated(keep=False)``)."""
    keys = list(keys)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    cnt = cnt.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_k")
    cond = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    j = df.join(cnt, cond, "left")
    return j.select(*df.columns, (F.col("_k") > 1).cast("int").alias(out))


def half_index(df: DataFrame, key, order) -> DataFrame:
    """Row position and a 0/1 half marker (first floor(n/2) rows = 0)."""
    w = subject_window(key, order)
    return (df.withColumn("_pos", F.row_number().over(w))
            .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*_as_list(key))))
            .withColumn("half", (F.col("_pos") > F.floor(F.col("_cnt") / 2)).cast("int"))
            .drop("_cnt"))
