"""Projection, filters, sorting, splits, sampling and set operations
(P1-P13, L1-L8, U1-U4).

Column-level decisions (which columns are sparse / empty) come from one
aggregate over all columns; row selections that need a position inside a
group (quotas, splits) use the distributed ``global_row_number`` instead of a
single-task window.  Splits and samples are deterministic: a row's fate
depends on ``xxhash64(key, seed)``, never on ``rand()`` or partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import finite, flag
from ..functions.stats import global_row_number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    return df.select([c for c in cols if c in df.columns])


def like_columns(df: DataFrame, keywords: Sequence[str], numeric_only: bool = False,
                 exclude: Sequence[str] = ()) -> list[str]:
    kws = [k.lower() for k in keywords]
    return [c for c in df.columns
            if any(k in c.lower() for k in kws) and c not in exclude
            and (not numeric_only or is_numeric(df, c))]


def select_like(df: DataFrame, keywords: Sequence[str], numeric_only: bool = False,
                keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains any keyword (case-insensitive)."""
    cols = list(keep) + like_columns(df, keywords, numeric_only, exclude=keep)
    return df.select(cols)


def split_by_modality(df: DataFrame, key: Sequence[str] | str, rules: Sequence[tuple[str, Sequence[str]]],
                      default: str | None = "other") -> dict[str, DataFrame]:
    """One projection per group; a column goes to the first group with a
    matching keyword, else to ``default`` (dropped when ``default`` is None)."""
    keys = [key] if isinstance(key, str) else list(key)
    groups: dict[str, list[str]] = {name: [] for name, _ in rules}
    if default:
        groups.setdefault(default, [])
    for c in df.columns:
        if c in keys:
            continue
        for name, kws in rules:
            if any(k.lower() in c.lower() for k in kws):
                groups[name].append(c)
                break
        else:
            if default:
                groups[default].append(c)
    return {g: df.select(*keys, *cols) for g, cols in groups.items() if cols}


def missing_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Share of nulls (NaN counts as null) of every column in one pass."""
    cols = list(cols or df.columns)
    def miss(c):
        x = F.col(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            return x.isNull() | F.isnan(x)
        return x.isNull()
    row = df.agg(*[F.avg(miss(c).cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in cols}


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.5, strict: bool = True,
                        keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose missing share is > max_missing (strict) or
    >= max_missing (``strict=False``)."""
    shares = missing_shares(df)
    bad = [c for c, s in shares.items() if c not in keep and (s > max_missing if strict else s >= max_missing)]
    return df.drop(*bad)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """P5: drop all-null columns."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if row[c] == 0])


def drop_matching(df: DataFrame, suffixes: Sequence[str] = (), cols: Sequence[str] = ()) -> DataFrame:
    """Drop columns by suffix or by name; absent names are ignored."""
    bad = [c for c in df.columns if c in set(cols) or any(c.endswith(s) for s in suffixes)]
    return df.drop(*bad)


drop_leakage = drop_matching


def dropna_subset(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows with nulls in the subset (``any`` / ``all``)."""
    return df.dropna(how=how, subset=list(subset))


def keep_plausible_rows(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Keep rows where the value is null or lo < value < hi."""
    return df.where(F.col(c).isNull() | ((F.col(c) > lo) & (F.col(c) < hi)))


def null_out_of_range(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Values outside [lo, hi] -> null."""
    return df.withColumn(c, F.when(F.col(c).between(lo, hi), F.col(c)))


def null_sentinels(df: DataFrame, c: str, codes: Sequence) -> DataFrame:
    """P10: sentinel codes (e.g. -4, 9999) -> null."""
    return df.withColumn(c, F.when(~F.col(c).isin(list(codes)), F.col(c)))


def null_infinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """+/-inf and NaN -> null in the given (floating) columns."""
    return df.select([finite(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column except the key columns."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def rule_flag(df: DataFrame, rules: Sequence[str], op: str = "and", out: str = "rule_flag") -> DataFrame:
    """SQL predicate strings combined with and / or -> 0/1 (null -> 0)."""
    conds = [F.expr(r) for r in rules]
    cond = reduce(lambda a, b: (a & b) if op == "and" else (a | b), conds)
    return df.withColumn(out, flag(cond))


# -- sort / limit / splits --------------------------------------------------------

def sort_rows(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool] | bool = True) -> DataFrame:
    """L1: multi-key sort, mixed directions."""
    asc = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(*[F.col(k).asc() if a else F.col(k).desc() for k, a in zip(keys, asc)])


def top_categories(df: DataFrame, c: str, k: int) -> DataFrame:
    """L2: the k most frequent values (ties by value)."""
    return (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(c)).limit(k))


def top_features(scores: DataFrame, score: str, k: int, by_abs: bool = True, name: str = "feature") -> DataFrame:
    """L3: top-k rows of a (feature, score) table."""
    key = F.abs(F.col(score)) if by_abs else F.col(score)
    return scores.orderBy(key.desc(), F.col(name).asc()).limit(k)


def hash_unit(key: Sequence[str] | str, seed: int = 42) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def split_random(df: DataFrame, key, train_frac: float = 0.8, seed: int = 42,
                 out: str = "is_train") -> DataFrame:
    """L4: stable hash split: ``pmod(xxhash64(key, seed), 100) < 100 * frac``."""
    return df.withColumn(out, (F.pmod(hash_unit(key, seed), F.lit(10000)) < int(round(train_frac * 10000))).cast("int"))


def split_stratified(df: DataFrame, key, label: str, train_frac: float = 0.8, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """Exact per-class split: within every class the first
    ``floor(n_c * frac)`` rows in hash order are train."""
    keys = [key] if isinstance(key, str) else list(key)
    h = df.withColumn("_h", hash_unit(keys, seed))
    rn = global_row_number(h, [label], ["_h", *keys], "_rn")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    return (rn.join(sizes, [label], "left")
            .withColumn(out, (F.col("_rn") <= F.floor(F.col("_nc") * train_frac)).cast("int"))
            .drop("_h", "_rn", "_nc"))


def split_time_ordered(df: DataFrame, order: Sequence[str], train_frac: float = 0.8,
                       out: str = "is_train") -> DataFrame:
    """The first ``int(n * frac)`` rows in time order are train."""
    n = df.count()
    cut = int(n * train_frac)
    rn = global_row_number(df, [], list(order), "_rn")
    return rn.withColumn(out, (F.col("_rn") <= cut).cast("int")).drop("_rn")


def time_series_folds(df: DataFrame, order: Sequence[str], n_splits: int = 5) -> DataFrame:
    """Expanding-window folds on the time-ordered rows: fold i trains on
    rows [0, start_i) and validates on [start_i, start_i + size) with
    size = n // (n_splits + 1) and start_i = n - (n_splits - i) * size.
    Returns (row_no, fold, role) rows, one per (row, fold) membership."""
    n = df.count()
    size = n // (n_splits + 1)
    rn = global_row_number(df, [], list(order), "row_no")
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    fold_rows = []
    for i, st in enumerate(starts):
        fold_rows.append(F.struct(F.lit(i).alias("fold"),
                                  F.when(F.col("row_no") <= st, "train")
                                  .when(F.col("row_no") <= st + size, "validate").alias("role")))
    return (rn.withColumn("_f", F.explode(F.array(*fold_rows)))
            .select("*", "_f.fold", "_f.role").drop("_f").where(F.col("role").isNotNull()))


def sample_stratified(df: DataFrame, key, label: str, n: int, seed: int = 42) -> DataFrame:
    """Per class min(n_c, max(1, n // n_classes)) rows in hash order, then
    at most ``n`` rows overall in hash order (rows with null label dropped)."""
    keys = [key] if isinstance(key, str) else list(key)
    base = df.where(F.col(label).isNotNull()).withColumn("_h", hash_unit(keys, seed))
    n_classes = base.select(label).distinct().count()
    quota = max(1, n // max(n_classes, 1))
    rn = global_row_number(base, [label], ["_h", *keys], "_rn")
    picked = rn.where(F.col("_rn") <= quota).drop("_rn")
    total = picked.count()
    if total <= n:
        return picked.drop("_h")
    rn2 = global_row_number(picked.withColumn("_h2", hash_unit(keys, seed + 1)), [], ["_h2", *keys], "_rn2")
    return rn2.where(F.col("_rn2") <= n).drop("_h", "_h2", "_rn2")


def keep_frequent(df: DataFrame, c: str, min_n: int = 20) -> DataFrame:
    """Keep rows whose category has more than ``min_n`` rows."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_n)
    return df.join(counts.select(c), c, "left_semi")


# -- set operations ----------------------------------------------------------------

def union_tables(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows; with a subset, keep the first row per subset in
    ``order`` (aggregate ``min_by``, pre-aggregated map-side)."""
    if subset is None:
        return df.distinct()
    if order is None:
        return df.dropDuplicates(list(subset))
    rest = [c for c in df.columns if c not in subset]
    ordkey = F.struct(*[F.col(o) for o in order])
    picked = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), ordkey).alias("_r"))
    return picked.select(*subset, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)


def keys_missing_from(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """Distinct keys of ``a`` that are absent from ``b``."""
    bk = b.select(F.col(b_key or key).alias(key))
    return a.select(key).distinct().join(bk, key, "left_anti")


def coalesce_columns(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    """U4: first non-null of two columns."""
    return df.withColumn(out or a, F.coalesce(F.col(a), F.col(b)))
