"""Imputation.

T1 / T2 are one aggregate plus a projection.  kNN imputation (T3 / T4)
follows the nan-Euclidean convention: the distance between two rows uses the
coordinates present in both, scaled by (all coordinates / shared
coordinates); a donor must have the target present; the imputed value is the
mean of the k nearest donors (ties -> smaller donor key); a receiver with no
comparable donor gets the column mean.

Scale: donors are cut into boxes, and a receiver (a row with a gap) is sent
only to boxes that can hold one of its k nearest donors (``neighbours.py``), in
blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import finite
from ..functions.stats import fit_stats, group_quantiles, lit_or_null, same_keys
from ..session import cut_lineage
from .neighbours import nearest_donors


def impute(df: DataFrame, cols: Sequence[str], how: str = "median") -> DataFrame:
    """Fill nulls with the column median / mean / mode (mode: most
    frequent value, ties -> smallest)."""
    if how in ("median", "mean"):
        st = fit_stats(df, {c: [how] for c in cols})
        fills = {c: st[(c, how)] for c in cols}
    elif how == "mode":
        fills = {}
        for c in cols:
            r = (df.where(F.col(c).isNotNull()).groupBy(c).count()
                 .orderBy(F.desc("count"), F.asc(c)).limit(1).collect())
            fills[c] = r[0][c] if r else None
    else:
        raise ValueError(how)
    return df.select([F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills and fills[c] is not None
                      else F.col(c) for c in df.columns])


def impute_by_group(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Fill with the group median, then with the global median."""
    med = None
    for c in cols:
        m = group_quantiles(df, [group], c, [0.5], [f"_gm_{c}"])
        med = m if med is None else same_keys(med, m, [group])
    st = fit_stats(df, {c: ["median"] for c in cols})
    j = same_keys(df, med, [group])
    return j.select([F.coalesce(F.col(c).cast("double"), F.col(f"_gm_{c}"), lit_or_null(st[(c, "median")])).alias(c)
                     if c in cols else F.col(c) for c in df.columns])


def impute_knn(df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str] | None = None,
               k: int = 5, group: str | None = None, receiver_rows: int = 1000, donor_rows: int = 5000, tested=None) -> DataFrame:
    """T3 (and T4 with ``group``): kNN imputation of ``targets`` (default all
    features, of which they must be a part) from the other rows, or those of
    the same group; ``key`` is a key of any type and must be unique and not
    null (an error else).  A group that is null has no donors.  NaN and infinite
    values are missing as coordinates; null targets are filled.

    Exact, but a receiver meets only the boxes of donors that can hold one of
    its k nearest (``neighbours.py``); ``tested`` is an accumulator of the pairs
    compared.
    """
    features = list(features)
    targets = list(targets or features)
    base = df.withColumn("_key", F.col(key))
    repeated = base.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("_key").isNull()).limit(1).collect()
    if repeated:
        raise ValueError(f"{key} is null or not unique: {repeated[0]['_key']!r}")
    miss = F.lit(False)
    for t in targets:
        miss = miss | F.col(t).isNull()
    means = fit_stats(df, {t: ["mean"] for t in targets})
    xs = [f"_x{i}" for i in range(len(features))]
    rows = base.select("_key", (F.col(group) if group else F.lit(0)).alias("_grp"),
                       *[finite(F.col(f).cast("double")).alias(x) for f, x in zip(features, xs)], miss.alias("_miss"))
    rows = rows.where(F.col("_grp").isNotNull())
    near = nearest_donors(rows, xs, [features.index(t) for t in targets], k, receiver_rows, donor_rows, tested)
    fills = near.groupBy("_rk", "_t").agg(F.avg("_val").alias("_fill"))
    wide = fills.groupBy(F.col("_rk").alias("_key")).pivot("_t", list(range(len(targets)))).agg(F.first("_fill"))
    out = base.join(wide, "_key", "left")
    sel = []
    for c in df.columns:
        if c in targets:
            i = targets.index(c)
            sel.append(F.coalesce(F.col(c).cast("double"), F.col(str(i)), lit_or_null(means[(c, "mean")])).alias(c))
        else:
            sel.append(F.col(c))
    return out.select(sel)


def impute_by_group_knn(df: DataFrame, key: str, group: str, features: Sequence[str], targets: Sequence[str],
                        k: int = 5, min_rows: int = 10) -> DataFrame:
    """T4: kNN within the group for groups with more than ``min_rows`` rows,
    group median for the others and for rows whose group is null."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    j = same_keys(df, sizes, [group])
    enough = (F.col("_gn") > min_rows) & F.col(group).isNotNull()
    big = j.where(enough).drop("_gn")
    small = j.where(~enough).drop("_gn")
    return (impute_knn(big, key, features, targets, k, group=group)
            .unionByName(impute_by_group(small, group, list(targets))))


def impute_auto(df: DataFrame, key: str, cols: Sequence[str], features: Sequence[str] | None = None,
                threshold: float = 0.5, k: int = 5) -> DataFrame:
    """T5: per column, median fill when more than ``threshold`` is missing,
    kNN otherwise."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    med = [c for c in cols if row[c] > threshold]
    knn = [c for c in cols if c not in med and row[c] > 0]
    out = impute(df, med, "median") if med else df
    if knn:
        out = impute_knn(out, key, list(features or cols), knn, k)
    return out


#: FIXED VALUES: the gamma priors of Bayesian ridge, its iterations and its tolerance.
_PRIOR, _ITERATIONS, _CHANGE = 1e-6, 300, 1e-3


#: Sums of Gram matrices that reach the driver at once.
GRAM_ROOTS = 16


def bayesian_ridge(gram: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of Bayesian ridge regression from the Gram
    matrix of (1, features, target) over n rows: noise and weight precisions
    by evidence maximisation, on the eigenvalues of the centred features."""
    mean = gram[0, 1:] / n
    c = gram[1:, 1:] - n * np.outer(mean, mean)
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], max(c[-1, -1], 0.0)
    values, vectors = np.linalg.eigh(xx)
    values, along = np.maximum(values, 0.0), vectors.T @ xy
    alpha, lam, coef = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    solve = lambda: vectors @ (along / (values + lam / alpha))
    for _ in range(_ITERATIONS):
        before, coef = coef, solve()
        rest = max(yy - 2 * coef @ xy + coef @ xx @ coef, 0.0)
        gamma = (alpha * values / (lam + alpha * values)).sum()
        lam = (gamma + 2 * _PRIOR) / ((coef ** 2).sum() + 2 * _PRIOR)
        alpha = (n - gamma + 2 * _PRIOR) / (rest + 2 * _PRIOR)
        if before is not None and np.abs(before - coef).sum() < _CHANGE:
            break
    coef = solve()
    return coef, float(mean[-1] - mean[:-1] @ coef)


def _filled(x: np.ndarray, missing: np.ndarray, updates: list) -> np.ndarray:
    """x after the round's updates so far: (column, coefficients of the other
    columns, intercept), in order."""
    x = x.copy()
    for c, coef, intercept in updates:
        rows = missing[:, c]
        x[rows, c] = np.delete(x[rows], c, axis=1) @ coef + intercept
    return x


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained-equation imputation.  Start from the column means; in each
    round, for each column (fewest missing first) fit a Bayesian ridge
    regression on the rows where it was observed, using the other columns'
    current values, and replace its missing entries by the prediction.  Ends
    after ``rounds`` rounds, or when no row changes by more than ``tol`` times
    the largest observed absolute value (summed over its columns).

    A fit is one scan, which adds the Gram matrix of its rows; the driver sees
    matrices of the columns only.  The table is written once a round.  NaN and
    infinite values are missing; a column without values stays null, is used
    as 0 and takes no part otherwise; a single column gets its mean.
    """
    import pyarrow as pa

    cols = list(cols)
    p = len(cols)
    value = [finite(F.col(c).cast("double")) for c in cols]
    first = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)], *[F.count(v).alias(f"n{i}") for i, v in enumerate(value)],
                   *[F.max(F.abs(v)).alias(f"a{i}") for i, v in enumerate(value)], F.count(F.lit(1)).alias("n")).first()
    means = [first[f"m{i}"] for i in range(p)]
    order = sorted((i for i in range(p) if 0 < first[f"n{i}"] < first["n"]), key=lambda i: (first["n"] - first[f"n{i}"], cols[i]))
    enough = tol * max((first[f"a{i}"] for i in range(p) if first[f"a{i}"] is not None), default=0.0)
    own = [f"_x{i}" for i in range(p)]
    cur = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(v, lit_or_null(m), F.lit(0.0)).alias(x) for v, m, x in zip(value, means, own)],
                    *[v.isNull().alias(f"_m{i}") for i, v in enumerate(value)])
    cur = cut_lineage(cur)

    def matrices(batch):
        return (np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in own], axis=1) if p else np.empty((batch.num_rows, 0)),
                np.stack([batch.column(f"_m{i}").to_numpy(zero_copy_only=False) for i in range(p)], axis=1) if p else np.empty((batch.num_rows, 0), bool))

    def gram_of(c: int, updates: list) -> tuple[np.ndarray, float]:
        def add(batches):
            total = np.zeros((p + 1, p + 1))
            for batch in batches:
                x, missing = matrices(batch)
                rows = ~missing[:, c]
                x = _filled(x[rows], missing[rows], updates) - centre
                z = np.column_stack([np.ones(len(x)), np.delete(x, c, axis=1), x[:, c]])
                total += z.T @ z
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "gram": [total.tobytes()]}, pa.schema([("part", pa.int32()), ("gram", pa.binary())]))

        def merge(key, t):
            held = t.sort_by("part").column("gram")
            return pa.table({"root": pa.array([key[0].as_py()], pa.int32()), "gram": pa.array([sum(np.frombuffer(g.as_py(), float) for g in held).tobytes()], pa.binary())})

        # one matrix per task; as many as GRAM_ROOTS sums of them reach the driver
        parts = cur.select(*own, *[f"_m{i}" for i in range(p)]).mapInArrow(add, "part int, gram binary")
        roots = parts.groupBy((F.col("part") % GRAM_ROOTS).alias("root")).applyInArrow(merge, "root int, gram binary")
        held = sorted((r["root"], r["gram"]) for r in roots.collect())
        total = sum((np.frombuffer(g, float) for _, g in held), np.zeros((p + 1) ** 2)).reshape(p + 1, p + 1)
        return total, total[0, 0]

    centre = np.array([m or 0.0 for m in means])
    for _ in range(rounds if p > 1 else 0):
        updates: list = []
        for c in order:
            gram, n = gram_of(c, updates)
            coef, intercept = bayesian_ridge(gram, n)
            others = np.delete(centre, c)
            updates.append((c, coef, intercept + centre[c] - others @ coef))
        if not updates:
            break

        def step(batches):
            for batch in batches:
                x, missing = matrices(batch)
                new = _filled(x, missing, updates)
                cols_out = [batch.column(n) if n not in own else pa.array(new[:, own.index(n)]) for n in batch.schema.names if n != "_change"]
                names = [n for n in batch.schema.names if n != "_change"]
                yield pa.RecordBatch.from_arrays([*cols_out, pa.array(np.abs(new - x).sum(axis=1))], names=[*names, "_change"])

        kept = cur.drop("_change")
        schema = T.StructType([*kept.schema.fields, T.StructField("_change", T.DoubleType())])
        cur = cut_lineage(kept.mapInArrow(step, schema))
        if (cur.agg(F.max("_change")).first()[0] or 0.0) < enough:
            break
    places = {c: i for i, c in enumerate(cols)}
    return cur.select(*[F.when(F.lit(means[places[c]] is not None), F.col(own[places[c]])).alias(c) if c in places else F.col(f"`{c}`") for c in df.columns])
