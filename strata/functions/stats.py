"""Exact column statistics, quantiles, ranks and row numbers without a
single-task group, and the Student-t tail probability.

``fit_stats`` is the "fit" half of a fit / transform pair: aggregates return
one row; operators then use the values as literals (same pattern as Spark
ML's scalers).  Exact quantiles (linear interpolation, the pandas default)
come from range-partitioned counts of distinct values at every size; pass
``approx=True`` for ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .nulls import col_


def corrected_skew(c) -> Column:
    """Bias-corrected sample skewness (pandas ``Series.skew``):
    g1 * sqrt(n(n-1)) / (n-2); 0 for a constant column, null for n < 3."""
    c = col_(c).cast("double")
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def corrected_kurt(c) -> Column:
    """Bias-corrected excess kurtosis (pandas ``Series.kurt``)."""
    c = col_(c).cast("double")
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)  # biased excess kurtosis
    return (F.when(n < 4, F.lit(None))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def _quantile_name(stat: str) -> float | None:
    # "p5" / "p95" / "q0.25" / "median"
    if stat == "median":
        return 0.5
    if stat.startswith("q"):
        return float(stat[1:])
    if stat.startswith("p") and stat[1:].replace(".", "").isdigit():
        return float(stat[1:]) / 100.0
    return None


def stat_expr(c: str, stat: str, approx: bool = False) -> Column:
    x = F.col(c).cast("double")
    q = _quantile_name(stat)
    if q is not None:
        return F.percentile_approx(x, q, 100000) if approx else F.percentile(x, q)
    return {
        "mean": lambda: F.avg(x),
        "std": lambda: F.stddev_samp(x),
        "std_pop": lambda: F.stddev_pop(x),
        "var": lambda: F.var_samp(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "sum": lambda: F.sum(x),
        "count": lambda: F.count(x),
        "nulls": lambda: F.count_if(F.col(c).isNull()),
        "skew": lambda: corrected_skew(c),
        "kurt": lambda: corrected_kurt(c),
        "n_distinct": lambda: F.count_distinct(F.col(c)),
    }[stat]()


def stats_frame(df: DataFrame, spec: Mapping[str, Iterable[str]], approx: bool = False) -> DataFrame:
    """One-row DataFrame with ``{col}__{stat}`` columns (lazy)."""
    exprs = [stat_expr(c, s, approx).alias(f"{c}__{s}") for c, stats in spec.items() for s in stats]
    return df.agg(*exprs)


def fit_stats(df: DataFrame, spec: Mapping[str, Iterable[str]], approx: bool = False) -> dict:
    """Run the aggregates and return ``{(col, stat): value}``.

    Plain statistics come from one job.  Quantiles come from the same job
    when ``approx``; exact ones from one ``group_quantiles`` over all their
    columns, whatever their size.
    """
    spec = {c: list(s) for c, s in spec.items()}
    quant = {} if approx else {c: [s for s in ss if _quantile_name(s) is not None] for c, ss in spec.items()}
    quant = {c: ss for c, ss in quant.items() if ss}
    plain = {c: [s for s in ss if s not in quant.get(c, ())] for c, ss in spec.items()}
    plain = {c: ss for c, ss in plain.items() if ss}
    out: dict = {}

    def put(c, s, v):
        out[(c, s)] = None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    if plain:
        row = stats_frame(df, plain, approx).first()
        for c, ss in plain.items():
            for s in ss:
                put(c, s, row[f"{c}__{s}"])
    if quant:
        qs = sorted({_quantile_name(s) for ss in quant.values() for s in ss})
        melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in quant])).alias("_e"))
        res = {r["_col"]: r for r in group_quantiles(melted.select("_e._col", "_e._v"), ["_col"], "_v", qs).collect()}
        for c, ss in quant.items():
            for s in ss:
                put(c, s, res[c][f"q{qs.index(_quantile_name(s))}"] if c in res else None)
    return out


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``a`` joined with ``b`` on ``keys``, null equal to null; ``b`` adds its
    other columns."""
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return a.join(b, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_positions(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """One row per group and distinct value: keys, ``_v``, ``_n`` (how often;
    0 for null), ``_before`` (smaller values of the group) and ``_size`` (its
    non-null values).

    Equal values are one row from the first partial aggregate on.  The rows
    are range-partitioned by (keys, value), each partition counts by itself,
    and a table with one row per group and partition supplies the offsets, so
    neither a large group nor a frequent value meets in one task.
    """
    counts = df.select(*keys, F.col(c).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    # written once: the partition of a row must not change between its two uses
    rows = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*keys, "_p").agg(F.sum("_n").alias("_t"))
    held = held.select(*keys, "_p", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                       F.sum("_t").over(Window.partitionBy(*keys)).alias("_size"))
    rows = same_keys(rows.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))), held, [*keys, "_p"])
    return rows.select(*keys, "_v", "_n", (F.col("_off") + F.col("_own")).alias("_before"), "_size")


def group_quantiles(df: DataFrame, keys: list[str], c: str, qs: list[float], names: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas, ``percentile``) per
    group, null keys being a group, as columns ``names`` (default q0, q1,
    ...); null for a group without values.  Without keys one row, always.

    The value at each needed rank is picked from ``value_positions`` by one
    partial aggregate; there is no other path for large groups.
    """
    names = names or [f"q{i}" for i in range(len(qs))]
    rows = value_positions(df, list(keys), c)
    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            there = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
            aggs.append(F.max(F.when(there, F.col("_v"))).alias(f"_{side}{i}"))
    got = rows.groupBy(*keys).agg(F.max("_size").alias("_size"), *aggs)
    out = []
    for i, (q, n) in enumerate(zip(qs, names)):
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(n))
    return got.select(*keys, *out)


def lit_or_null(v) -> Column:
    return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")


def rank_pct(df: DataFrame, c: str, out: str, ascending: bool = True) -> DataFrame:
    """Average-rank percentile ``(rank + (ties - 1) / 2) / n_non_null``
    (pandas ``rank(pct=True)``), null for null input.

    Ranks are those of the distinct values (``value_positions``), joined back
    by value; both sides of that join are shuffled by nothing else, so a
    frequent value can be split.
    """
    key = F.col(c).cast("double") * F.lit(1.0 if ascending else -1.0)
    ranks = value_positions(df.select(key.alias("_v")).where(F.col("_v").isNotNull()), [], "_v")
    ranks = cut_lineage(ranks.select("_v", ((F.col("_before") + (F.col("_n") + 1) / 2.0) / F.col("_size")).alias(out)))
    return df.withColumn("_v", key).join(ranks, "_v", "left").drop("_v")


# ---------------------------------------------------------------------------
#: FIXED VALUES: the largest number of levels of the continued fraction, and
#: the shift from which Stirling's series of ln gamma (four terms) is used.
_LEVELS, _SHIFT = 600, 8


def ln_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0: Stirling's series at
    x + 8, less the logarithm of the factors between."""
    between = x
    for i in range(1, _SHIFT):
        between = between * (x + i)
    y = x + _SHIFT
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z / 1680))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(between)


def t_pvalue(t, dof) -> Column:
    """Two-sided Student-t p-value as an expression: the regularised incomplete
    beta function I_x(dof / 2, 1 / 2) at x = dof / (dof + t^2), by its continued
    fraction from the last level up.  The fraction is taken on the side on which
    it converges fast; levels grow with the square root of dof, to at most 600.
    Null where t or dof is null or not finite, or dof is not positive."""
    t, nu = col_(t).cast("double"), col_(dof).cast("double")
    inf = float("inf")
    valid = (F.abs(t) < inf) & (nu > 0) & (nu < inf)  # NaN is above infinity
    t, nu = F.when(valid, t), F.when(valid, nu)
    x, rest = nu / (nu + t * t), t * t / (nu + t * t)
    low = x < (nu / 2 + 1) / (nu / 2 + 2.5)
    half = F.lit(0.5)
    p = F.struct(F.when(low, nu / 2).otherwise(half).alias("a"), F.when(low, half).otherwise(nu / 2).alias("b"),
                 F.when(low, x).otherwise(rest).alias("x"))

    def level(below: Column, m: Column) -> Column:
        a, b, at, i = p["a"], p["b"], p["x"], F.floor(m / 2)
        odd = -(a + i) * (a + b + i) * at / ((a + m - 1) * (a + m))
        even = i * (b - i) * at / ((a + m - 1) * (a + m))
        return F.try_divide(F.when(m % 2 == 1, odd).otherwise(even), 1.0 + below)

    levels = F.least(F.lit(_LEVELS), 40 + 6 * F.ceil(F.sqrt(nu))).cast("int")
    tail = F.aggregate(F.sequence(levels, F.lit(1), F.lit(-1)), F.lit(0.0), level)
    # x^(dof/2) (1-x)^(1/2) / B(dof/2, 1/2), with ln x as a logarithm near 1
    ln_front = -nu / 2 * F.log1p(t * t / nu) + half * F.ln(rest) - (ln_gamma(nu / 2) + 0.5 * math.log(math.pi) - ln_gamma(nu / 2 + 0.5))
    part = F.try_divide(F.exp(ln_front) / p["a"], 1.0 + tail)
    return F.when(t == 0, 1.0).otherwise(F.when(low, part).otherwise(1.0 - part))


def global_row_number(df: DataFrame, groups: list[str], order: list, out: str = "row_no") -> DataFrame:
    """Exact ``row_number() over (partition by groups order by order)`` that
    never puts a whole group into one task.

    Rows are range-partitioned and sorted by groups and the whole order, so
    that a group, or rows that agree on the first order column, spread over
    partitions.  Row numbers inside a partition and a table with one row per
    group and partition give the rest.  ``order`` must be a total order (end
    in a unique key) for the result to be deterministic.
    """
    by = [*groups, *order]
    # written once: the place of a row must not change between its two uses
    rows = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_at", 33))
    held = rows.groupBy(*groups, "_p").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    held = cut_lineage(held.select(*groups, "_p", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    return same_keys(rows, held, [*groups, "_p"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_p", "_shift")


def _slots(df: DataFrame, c: str) -> tuple[Column, Column, Column] | None:
    """A value as (long, double, string), one of them filled, so that values
    of a column are equal exactly when their slots are; None for nested types."""
    x, t = F.col(c), df.schema[c].dataType
    whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        whole = x.cast("long")
    elif isinstance(t, T.DateType):
        whole = F.unix_date(x).cast("long")
    elif isinstance(t, T.TimestampType):
        whole = F.unix_micros(x)
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        real = x.cast("double")
    elif isinstance(t, T.BinaryType):
        text = F.hex(x)
    elif t == T.StringType() or isinstance(t, (T.DecimalType, T.TimestampNTZType)):
        text = x.cast("string")
    else:
        return None
    return whole, real, text


def distinct_counts(df: DataFrame, names: Mapping[str, str], approx: bool = False) -> list[DataFrame]:
    """One-row frames with the distinct count of each column, under the given
    names (nulls are not counted; NaN is a value, -0.0 equals 0.0).

    Exact counts of all columns come from one scan and one shuffle: rows are
    melted to (column, value), tasks drop repeated pairs before the shuffle, and
    a value's hash, not its column, decides which task counts it.  Columns of
    nested types, which have no such form, share one aggregate of their own."""
    if approx:
        return [df.agg(*[F.approx_count_distinct(c).alias(n) for c, n in names.items()])] if names else []
    flat, nested = {}, []
    for c in names:
        slots = _slots(df, c)
        if slots is None:
            nested.append(c)
        else:
            flat[c] = slots
    out = []
    if flat:
        entries = [F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"), t.alias("t")) for i, (a, b, t) in enumerate(flat.values())]
        pairs = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("a IS NOT NULL OR b IS NOT NULL OR t IS NOT NULL")
        counts = pairs.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        out.append(counts.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(names[c]) for i, c in enumerate(flat)]))
    if nested:
        out.append(df.agg(*[F.count_distinct(F.col(c)).alias(names[c]) for c in nested]))
    return out


def pair_corr(x, y) -> Column:
    """Pearson correlation over rows where both are present (like ``corr``)
    but null instead of an ANSI divide-by-zero error for a constant side."""
    x, y = col_(x).cast("double"), col_(y).cast("double")
    xx, yy = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xx, yy), F.sqrt(F.var_pop(xx) * F.var_pop(yy)))
