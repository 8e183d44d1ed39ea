"""Data quality and profiling.

Every profile is one aggregate over all requested columns (a single scan)
reshaped into a long table -- one row per column or per metric -- so the
output is a small DataFrame instead of a nested report.  Duplicate checks
group by all columns (a shuffle, pre-aggregated map-side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import corrected_skew, distinct_counts, pair_corr
from .agg import _one_row_concat, corr_matrix
from .select import NUMERIC


def _kind(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType
    if isinstance(t, NUMERIC):
        return "numeric"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def _missing(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def length_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min / max string length of each column (one row)."""
    return df.agg(*[e for c in cols for e in (F.min(F.length(c)).alias(f"{c}_min_len"),
                                                F.max(F.length(c)).alias(f"{c}_max_len"))])


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, approx_distinct: bool = False) -> DataFrame:
    """Q1: one row per column: type, non-null count, null %, distinct count,
    numeric min / max / mean / std, string min / max length."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        k = _kind(df, c)
        x = F.col(c)
        aggs.append(F.count_if(~_missing(df, c)).alias(f"nn{i}"))
        if k == "numeric":
            xd = x.cast("double")
            aggs += [F.min(xd).alias(f"mn{i}"), F.max(xd).alias(f"mx{i}"), F.avg(xd).alias(f"av{i}"),
                     F.stddev_samp(xd).alias(f"sd{i}")]
        if k == "string":
            aggs += [F.min(F.length(x)).alias(f"ln{i}"), F.max(F.length(x)).alias(f"lx{i}")]
    row = reduce(_one_row_concat, distinct_counts(df, {c: f"nd{i}" for i, c in enumerate(cols)}, approx_distinct), df.agg(*aggs))
    dbl, lng = F.lit(None).cast("double"), F.lit(None).cast("int")
    entries = []
    for i, c in enumerate(cols):
        k = _kind(df, c)
        num = k == "numeric"
        st = k == "string"
        entries.append(F.struct(
            F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"nn{i}").alias("non_null"),
            (100.0 * (F.col("_rows") - F.col(f"nn{i}")) / F.col("_rows")).alias("null_pct"),
            F.col(f"nd{i}").alias("n_distinct"),
            (F.col(f"mn{i}") if num else dbl).alias("min"), (F.col(f"mx{i}") if num else dbl).alias("max"),
            (F.col(f"av{i}") if num else dbl).alias("mean"), (F.col(f"sd{i}") if num else dbl).alias("std"),
            (F.col(f"ln{i}") if st else lng).alias("min_len"), (F.col(f"lx{i}") if st else lng).alias("max_len")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_report(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Q2: per (dataset, column) missing count and share, plus the dataset's
    overall missing share on every row (one aggregate per dataset)."""
    parts = []
    for name, df in sources.items():
        cols = df.columns
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
        total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
        entries = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
                            (100.0 * F.col(f"m{i}") / F.col("_rows")).alias("missing_pct")) for i, c in enumerate(cols)]
        parts.append(row.select(F.lit(name).alias("dataset"),
                                (100.0 * total / (F.col("_rows") * len(cols))).alias("dataset_missing_pct"),
                                F.explode(F.array(*entries)).alias("e")).select("dataset", "e.*", "dataset_missing_pct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ID_WORDS = ("id", "key", "rid", "ptid", "subject", "patient")


def id_candidates(df: DataFrame, words: Sequence[str] = ID_WORDS) -> DataFrame:
    """Q3: columns whose name suggests an identifier, their distinct counts,
    and which one has the most distinct values."""
    cands = [c for c in df.columns if any(w in c.lower() for w in words)]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, is_best int")
    row = reduce(_one_row_concat, distinct_counts(df, {c: f"d{i}" for i, c in enumerate(cands)}))
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                                          for i, c in enumerate(cands)])).alias("e")).select("e.*")
    return _with_best(long)


def _with_best(long: DataFrame) -> DataFrame:
    top = long.orderBy(F.desc("n_distinct"), "column").limit(1).select(F.col("column").alias("_best"))
    return long.join(top, F.col("column") == F.col("_best"), "left").select(
        "column", "n_distinct", F.col("_best").isNotNull().cast("int").alias("is_best"))


DATE_WORDS = ("date", "time", "dt", "fecha")


def date_candidates(df: DataFrame, min_share: float = 0.8, words: Sequence[str] = DATE_WORDS) -> DataFrame:
    """Q4: for every string column, the share of non-null values that parse
    as a date / timestamp; a column is a candidate when its name contains a
    date word or the share reaches ``min_share`` (all rows are tested, not a
    sample)."""
    cols = [c for c in df.columns if _kind(df, c) == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, parse_share double, name_hint int, is_candidate int")
    aggs = []
    for i, c in enumerate(cols):
        ok = F.try_to_timestamp(F.trim(F.col(c))).isNotNull()
        aggs += [F.count_if(ok).alias(f"p{i}"), F.count(F.col(c)).alias(f"n{i}")]
    row = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"p{i}"), F.col(f"n{i}")).alias("parse_share"),
                        F.lit(int(any(w in c.lower() for w in words))).alias("name_hint")) for i, c in enumerate(cols)]
    out = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return out.withColumn("is_candidate", ((F.col("name_hint") == 1) | (F.coalesce(F.col("parse_share"), F.lit(0.0)) >= min_share)).cast("int"))


def date_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q5: per temporal column: min, max, valid and missing counts."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in
                   (F.min(c).cast("timestamp_ntz").alias(f"a{i}"), F.max(c).cast("timestamp_ntz").alias(f"b{i}"),
                    F.count(c).alias(f"v{i}"), F.count_if(F.col(c).isNull()).alias(f"m{i}"))])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min_date"), F.col(f"b{i}").alias("max_date"),
                        F.col(f"v{i}").alias("valid_dates"), F.col(f"m{i}").alias("missing_dates")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every identical group (one aggregate)."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows")))


def validate_table(df: DataFrame, key: str, sparse: float = 0.5) -> DataFrame:
    """Q6: rows, columns, subjects, missing cells, columns with more than 50 %
    missing, duplicate rows and subjects appearing more than once; long form."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(key).alias("_subj"),
                 *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    dup = _duplicate_rows(df)
    multi = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("dup_subjects"))
    r = _one_row_concat(_one_row_concat(row, dup), multi)
    miss = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    sparse_cols = sum(((F.col(f"m{i}") / F.col("_rows") > sparse).cast("int") for i in range(len(cols))), F.lit(0))
    metrics = [("rows", F.col("_rows")), ("columns", F.lit(len(cols))), ("subjects", F.col("_subj")),
               ("missing_cells", miss), ("missing_pct", 100.0 * miss / (F.col("_rows") * len(cols))),
               ("sparse_columns", sparse_cols), ("duplicate_rows", F.col("duplicate_rows")),
               ("duplicate_subjects", F.col("dup_subjects"))]
    return _metrics_long(r, metrics)


def _metrics_long(row: DataFrame, metrics: Sequence[tuple[str, Column]]) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("metric"), e.cast("double").alias("value")) for n, e in metrics]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def modality_completeness(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q7: per modality: mean / min / max of the non-null share of its columns."""
    cols = sorted({c for cs in groups.values() for c in cs})
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(~_missing(df, c)).alias(f"c_{c}") for c in cols])
    entries = []
    for g, cs in groups.items():
        shares = [F.col(f"c_{c}") / F.col("_rows") for c in cs]
        entries.append(F.struct(F.lit(g).alias("modality"), F.lit(len(cs)).alias("n_columns"),
                                (sum(shares, F.lit(0.0)) / len(cs)).alias("mean_completeness"),
                                F.least(*shares).alias("min_completeness") if len(shares) > 1 else shares[0].alias("min_completeness"),
                                F.greatest(*shares).alias("max_completeness") if len(shares) > 1 else shares[0].alias("max_completeness")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def feature_quality(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Q8: completeness before / after, feature counts, variance statistics of
    numeric features, and target mean / std / skew / range; long form."""
    def comp(df):
        cols = df.columns
        return df.agg((100.0 * (1 - sum((F.count_if(_missing(df, c)) for c in cols), F.lit(0)) /
                                (F.count(F.lit(1)) * len(cols)))).alias("c"))
    num = [c for c in after.columns if _kind(after, c) == "numeric" and c != target]
    y = F.col(target).cast("double")
    a = after.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(num)],
                  F.avg(y).alias("t_mean"), F.stddev_samp(y).alias("t_std"), corrected_skew(target).alias("t_skew"),
                  (F.max(y) - F.min(y)).alias("t_range"))
    r = _one_row_concat(_one_row_concat(comp(before).select(F.col("c").alias("c0")), comp(after).select(F.col("c").alias("c1"))), a)
    vs = [F.col(f"v{i}") for i in range(len(num))]
    vsum = sum((F.coalesce(v, F.lit(0.0)) for v in vs), F.lit(0.0))
    vcnt = sum((v.isNotNull().cast("int") for v in vs), F.lit(0))
    metrics = [("completeness_before", F.col("c0")), ("completeness_after", F.col("c1")),
               ("completeness_gain", F.col("c1") - F.col("c0")),
               ("features_before", F.lit(len(before.columns))), ("features_after", F.lit(len(after.columns))),
               ("reduction_ratio", F.lit(1 - len(after.columns) / len(before.columns))),
               ("mean_variance", F.try_divide(vsum, vcnt)),
               ("min_variance", F.least(*vs) if len(vs) > 1 else vs[0]),
               ("max_variance", F.greatest(*vs) if len(vs) > 1 else vs[0]),
               ("zero_variance_features", sum(((v == 0).cast("int") for v in vs), F.lit(0))),
               ("target_mean", F.col("t_mean")), ("target_std", F.col("t_std")),
               ("target_skew", F.col("t_skew")), ("target_range", F.col("t_range"))]
    return _metrics_long(r, metrics)


def final_checks(df: DataFrame, target: str, category: str | None = None) -> DataFrame:
    """Q9: rule rows (rule, level, value, passed): target present in >= 50 %
    of rows, zero-variance features, category balance >= 0.1, completeness
    >= 70 %, no duplicate rows.  ``level`` is issue (fails the table) or
    warning."""
    cols = df.columns
    num = [c for c in cols if _kind(df, c) == "numeric"]
    a = df.agg(F.count(F.lit(1)).alias("_rows"), F.count(F.col(target)).alias("_tv"),
               *[F.var_samp(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(num)],
               (sum((F.count_if(_missing(df, c)) for c in cols), F.lit(0))).alias("_miss"))
    parts = [a, _duplicate_rows(df)]
    if category:
        cc = df.where(F.col(category).isNotNull()).groupBy(category).count().agg(
            F.try_divide(F.min("count"), F.max("count")).alias("_bal"))
        parts.append(cc)
    r = parts[0]
    for p in parts[1:]:
        r = _one_row_concat(r, p)
    zero = sum(((F.col(f"v{i}") == 0).cast("int") for i in range(len(num))), F.lit(0))
    comp = 100.0 * (1 - F.col("_miss") / (F.col("_rows") * len(cols)))
    rules = [("target_valid_rows", "issue", F.col("_tv"), F.col("_tv") > 0),
             ("target_valid_share", "warning", F.col("_tv") / F.col("_rows"), F.col("_tv") >= F.col("_rows") * 0.5),
             ("zero_variance_features", "warning", zero, zero == 0),
             ("completeness_pct", "warning", comp, comp >= 70),
             ("duplicate_rows", "warning", F.col("duplicate_rows"), F.col("duplicate_rows") == 0)]
    if category:
        rules.append(("category_balance", "warning", F.col("_bal"), F.coalesce(F.col("_bal") >= 0.1, F.lit(True))))
    entries = [F.struct(F.lit(n).alias("rule"), F.lit(lv).alias("level"), v.cast("double").alias("value"),
                        ok.cast("int").alias("passed")) for n, lv, v, ok in rules]
    return r.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def modelling_quality(df: DataFrame, target: str, approx_distinct: bool = False) -> DataFrame:
    """Q10: rows, features, target missing, mean missing % over features,
    duplicate rows, constant features; long form."""
    feats = [c for c in df.columns if c != target]
    a = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(target).isNull()).alias("_tm"),
               *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(feats)])
    counts = distinct_counts(df, {c: f"d{i}" for i, c in enumerate(feats)}, approx_distinct)
    r = reduce(_one_row_concat, [_duplicate_rows(df), *counts], a)
    mean_missing = sum((100.0 * F.col(f"m{i}") / F.col("_rows") for i in range(len(feats))), F.lit(0.0)) / len(feats)
    const = sum(((F.col(f"d{i}") <= 1).cast("int") for i in range(len(feats))), F.lit(0))
    return _metrics_long(r, [("rows", F.col("_rows")), ("features", F.lit(len(feats))), ("target_missing", F.col("_tm")),
                             ("mean_missing_pct", mean_missing), ("duplicate_rows", F.col("duplicate_rows")),
                             ("constant_features", const)])


def select_features(df: DataFrame, target: str, cols: Sequence[str], threshold: float = 0.1, min_obs: int = 10,
                    patterns: Sequence[str] = ()) -> DataFrame:
    """Q11: features with |corr(target)| >= threshold over more than
    ``min_obs`` complete pairs, united with the columns matching name
    patterns; one row per selected feature with the reason."""
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [pair_corr(F.col(c), y).alias(f"r{i}"),
                 F.count(F.when(F.col(c).isNotNull() & y.isNotNull(), 1)).alias(f"n{i}")]
    row = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("corr"), F.col(f"n{i}").alias("n_obs"),
                        F.lit(int(any(p.lower() in c.lower() for p in patterns))).alias("pattern_match"))
               for i, c in enumerate(cols)]
    long = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    by_corr = (F.abs(F.col("corr")) >= threshold) & (F.col("n_obs") >= min_obs)
    return (long.withColumn("by_corr", F.coalesce(by_corr, F.lit(False)).cast("int"))
            .where((F.col("by_corr") == 1) | (F.col("pattern_match") == 1)))


def imbalance_ratio(df: DataFrame, c: str) -> DataFrame:
    """Q12: largest class count / smallest class count."""
    return (df.where(F.col(c).isNotNull()).groupBy(c).count()
            .agg(F.max("count").alias("max_class"), F.min("count").alias("min_class"),
                 F.try_divide(F.max("count"), F.min("count")).alias("imbalance_ratio")))


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q13: count, mean, std, min, exact quartiles, max per column (long)."""
    from ..functions.stats import fit_stats
    st = fit_stats(df, {c: ["count", "mean", "std", "min", "q0.25", "q0.5", "q0.75", "max"] for c in cols})
    rows = [(c, st[(c, "count")], st[(c, "mean")], st[(c, "std")], st[(c, "min")], st[(c, "q0.25")],
             st[(c, "q0.5")], st[(c, "q0.75")], st[(c, "max")]) for c in cols]
    schema = ("column string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return df.sparkSession.createDataFrame(rows, schema)


def missing_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q14: correlation matrix of the null indicators (long form)."""
    ind = df.select(*[_missing(df, c).cast("double").alias(c) for c in cols])
    return corr_matrix(ind, cols)


def modality_summary(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q15: per modality: feature count, numeric feature count, records and
    mean missing % of its columns."""
    cols = sorted({c for cs in groups.values() for c in cs})
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(f"m_{c}") for c in cols])
    entries = []
    for g, cs in groups.items():
        n_num = sum(1 for c in cs if _kind(df, c) == "numeric")
        miss = sum((100.0 * F.col(f"m_{c}") / F.col("_rows") for c in cs), F.lit(0.0)) / len(cs)
        entries.append(F.struct(F.lit(g).alias("modality"), F.lit(len(cs)).alias("n_features"),
                                F.lit(n_num).alias("n_numeric"), F.col("_rows").alias("records"),
                                miss.alias("missing_pct")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
