"""Aggregation operators.

All are ``groupBy`` aggregates (partial aggregation map-side, final after
the shuffle), so a hot key is reduced before it moves.  Shares divide by a
total obtained from a one-number aggregate, never by a single-task window
over an unbounded set of groups.  Correlations ignore rows where either side
is null (pairwise complete), as Spark's ``corr`` does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from ..functions.gram import pair_correlations
from ..functions.stats import distinct_counts, group_quantiles, pair_corr, same_keys, t_pvalue

_FNS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count, "sum": F.sum,
}


def agg_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                fns: Sequence[str] = ("mean", "std", "min", "max"), suffix: str = "") -> DataFrame:
    """A1: per group, every statistic of every measure as ``{col}_{fn}{suffix}``
    (``median`` is exact, null keys being a group)."""
    plain = [f for f in fns if f != "median"]
    out = df.groupBy(*keys).agg(*[_FNS[f](F.col(c).cast("double") if f != "count" else F.col(c)).alias(f"{c}_{f}{suffix}")
                                  for c in cols for f in plain])
    if "median" in fns:
        for c in cols:
            out = same_keys(out, group_quantiles(df, list(keys), c, [0.5], [f"{c}_median{suffix}"]), list(keys))
        out = out.select(*keys, *[f"{c}_{f}{suffix}" for c in cols for f in fns])
    return out


def agg_calendar(df: DataFrame, key: str, ts: str, unit: str, cols: Sequence[str],
                 fns: Sequence[str] = ("mean", "std", "min", "max"), with_year: bool = False) -> DataFrame:
    """A2: per (subject, ISO week) or (subject, month); the reference keys on
    week / month only, ``with_year=True`` adds the (ISO) year."""
    part = {"week": F.weekofyear(ts), "month": F.month(ts)}[unit].alias(unit)
    keys = [F.col(key), part]
    if with_year:
        keys.insert(1, (F.year(F.date_add(F.to_date(ts), 3 - F.weekday(ts))) if unit == "week" else F.year(ts)).alias("year"))
    suffix = {"week": "_weekly", "month": "_monthly"}[unit]
    return df.groupBy(*keys).agg(*[_FNS[f](F.col(c).cast("double")).alias(f"{c}_{f}{suffix}") for c in cols for f in fns])


def weekday_weekend_variation(df: DataFrame, key: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """A3: per subject, weekday mean, weekend mean and the relative variation
    ``(weekend - weekday) / weekday * 100`` (zero weekday mean -> null), in
    one pass with conditional averages."""
    we = F.weekday(ts) >= 5
    out = []
    for c in cols:
        wd = F.avg(F.when(~we, F.col(c).cast("double")))
        wk = F.avg(F.when(we, F.col(c).cast("double")))
        out += [wd.alias(f"{c}_weekday"), wk.alias(f"{c}_weekend")]
    g = df.groupBy(key).agg(*out)
    return g.select("*", *[(safe_div(F.col(f"{c}_weekend") - F.col(f"{c}_weekday"), F.col(f"{c}_weekday")) * 100)
                           .alias(f"{c}_variation") for c in cols])


def median_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A4: exact median of each column per key (collapse repeated measurements)."""
    out = None
    for c in cols:
        m = group_quantiles(df, list(keys), c, [0.5], [c])
        out = m if out is None else out.join(m, list(keys), "full")
    return out


def value_counts(df: DataFrame, c: str, normalize: bool = True) -> DataFrame:
    """Count per value (null excluded) and its share of non-null rows."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    total = df.where(F.col(c).isNotNull()).count()
    return counts.withColumn("proportion", F.col("count") / F.lit(float(total)) if total else F.lit(None))


def crosstab_long(df: DataFrame, a: str, b: str, normalize: str | None = None,
                  margins: bool = False, margin_label: str = "All") -> DataFrame:
    """A7 in long form: (a, b, count[, share]).  ``normalize='index'`` divides
    by the row total; ``margins`` adds the ``All`` row / column via ``cube``."""
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if margins:
        g = (base.cube(a, b).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
             .select(F.when(F.col("_gid").bitwiseAND(2) > 0, F.lit(margin_label)).otherwise(F.col(a).cast("string")).alias(a),
                     F.when(F.col("_gid").bitwiseAND(1) > 0, F.lit(margin_label)).otherwise(F.col(b).cast("string")).alias(b),
                     "count"))
    else:
        g = base.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    if normalize == "index":
        rows = base.groupBy(a).agg(F.count(F.lit(1)).alias("_row"))
        if margins:
            rows = rows.select(F.col(a).cast("string").alias(a), "_row").unionByName(
                base.agg(F.count(F.lit(1)).alias("_row")).select(F.lit(margin_label).alias(a), "_row"))
        g = g.join(rows, a, "left").withColumn("share", F.col("count") / F.col("_row")).drop("_row")
    return g


def pivot_count(df: DataFrame, index: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Count per (index, column value) as a wide table, missing -> 0.
    Pass ``values`` to skip the distinct-values job."""
    g = df.groupBy(index)
    p = g.pivot(columns, list(values)) if values is not None else g.pivot(columns)
    return p.count().fillna(0)


def distinct_profile(df: DataFrame, key: str, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct count of every column, rows, and records per subject."""
    cols = list(cols or df.columns)
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    a = reduce(_one_row_concat, distinct_counts(df, {c: f"{c}_distinct" for c in cols}, approx), df.agg(F.count(F.lit(1)).alias("rows")))
    b = per.agg(F.avg("_r").alias("records_per_subject_mean"), F.max("_r").alias("records_per_subject_max"))
    return _one_row_concat(a, b)


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side concat of two one-row frames through a constant key."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def stratum_profile(df: DataFrame, stratum: str, target: str, digits: int = 3) -> DataFrame:
    """A10: mean / std / count / median / min / max of ``target`` per stratum,
    rounded to 3 decimals."""
    y = F.col(target).cast("double")
    g = df.groupBy(stratum).agg(
        F.round(F.avg(y), digits).alias("mean"), F.round(F.stddev_samp(y), digits).alias("std"),
        F.count(y).alias("count"), F.round(F.min(y), digits).alias("min"), F.round(F.max(y), digits).alias("max"))
    med = group_quantiles(df, [stratum], target, [0.5], ["_med"])
    return same_keys(g, med, [stratum]).select(stratum, "mean", "std", "count", F.round("_med", digits).alias("median"),
                                                 "min", "max")


#: Pairs of one aggregate: more expressions than its generated code can hold would be interpreted.
CORR_TILE = 300


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair (pairwise complete) in
    long form (a, b, corr), in one scan: one aggregate over the upper triangle
    of up to CORR_TILE pairs (24 columns), a masked Gram matrix beyond
    (``functions.gram``; NaN and infinite values are missing there)."""
    cols = list(cols)
    if len(cols) * (len(cols) + 1) // 2 > CORR_TILE:
        names = F.array(*map(F.lit, cols))
        return pair_correlations(df, cols).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "corr")
    x = [F.col(c).cast("double") for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[(pair_corr(x[i], x[j]) if i < j else F.when(F.stddev_samp(x[i]) > 0, F.lit(1.0))).alias(f"c{i}_{j}") for i, j in pairs])
    entries = [F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), F.col(f"c{i}_{j}").alias("corr"))
               for i, j in pairs for a, b in dict.fromkeys([(i, j), (j, i)])]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.a", "e.b", "e.corr")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str, min_obs: int = 10) -> DataFrame:
    """Correlation of each column with the target and the number of
    complete pairs; kept when pairs > ``min_obs``; ordered by |corr| desc."""
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [pair_corr(x, y).alias(f"r{i}"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")]
    row = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("corr"), F.col(f"n{i}").alias("n_obs"))
               for i, c in enumerate(cols)]
    long = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return (long.where((F.col("n_obs") > min_obs) & F.col("corr").isNotNull())
            .withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "feature"))


def corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs (upper triangle, list order) with |corr| above the threshold."""
    order = {c: i for i, c in enumerate(cols)}
    m = corr_matrix(df, cols)
    idx = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return m.where((idx[F.col("a")] < idx[F.col("b")]) & (F.abs("corr") > threshold))


def welch_t(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Welch two-sample t statistic, Welch-Satterthwaite degrees of
    freedom and two-sided p-value between groups ``a`` and ``b``."""
    y = F.col(value).cast("double")
    ga, gb = F.col(group) == F.lit(a), F.col(group) == F.lit(b)
    s = df.where(y.isNotNull()).agg(
        F.count(F.when(ga, y)).alias("n_a"), F.avg(F.when(ga, y)).alias("mean_a"), F.var_samp(F.when(ga, y)).alias("var_a"),
        F.count(F.when(gb, y)).alias("n_b"), F.avg(F.when(gb, y)).alias("mean_b"), F.var_samp(F.when(gb, y)).alias("var_b"))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    out = s.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t_stat"), dof.alias("dof"))
    return out.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("dof")))


def time_bin_profile(df: DataFrame, months: str, y: str, width: int = 6) -> DataFrame:
    """Mean / std / count of ``y`` per ``floor(months / width) * width`` bin,
    plus (last bin mean - first bin mean) / number of bins on every row."""
    b = (F.floor(F.col(months) / width) * width).cast("double")
    g = df.where(F.col(months).isNotNull()).groupBy(b.alias("time_bin")).agg(
        F.avg(F.col(y).cast("double")).alias("mean"), F.stddev_samp(F.col(y).cast("double")).alias("std"),
        F.count(F.col(y)).alias("count"))
    # bins are few (range of time / width): the summary window is tiny
    w = Window.orderBy("time_bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inc = (F.last("mean").over(w) - F.first("mean").over(w)) / F.count(F.lit(1)).over(w)
    return g.withColumn("mean_increase_per_bin", inc)


def monthly_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per calendar month."""
    return (df.groupBy(F.to_date(F.date_trunc("month", F.col(ts))).alias("month"))
            .agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count(F.col(value)).alias("count")))


def yearly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per calendar year."""
    return df.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("count"))


def trend_of_means(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Least-squares slope of the group means over the ordinal."""
    means = df.groupBy(ordinal).agg(F.avg(F.col(value).cast("double")).alias("_m"))
    return means.agg(F.regr_slope("_m", F.col(ordinal).cast("double")).alias("slope"),
                     F.count(F.lit(1)).alias("n_groups"))
