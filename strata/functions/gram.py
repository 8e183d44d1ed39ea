"""Masked Gram matrix: sums of all column pairs over the rows that hold both,
in one scan for any number of columns.

With X the values (0 where missing) and M the mask of present values, X'X,
X'M, (X*X)'M and M'M hold every pair's sum of products, sums, sums of squares
and number of complete rows.  Each task multiplies its batches (BLAS), and
tiles of TILE rows of the matrices are added by tasks, in the order of the
tasks that made them.  Values are taken about one value of their column, so
that sums of squares keep their digits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the matrices in one tile.
TILE = 64

#: A sum of squares below this share of the squares about the column's origin is rounding.
NOISE = 1e-12

_NAMES = ("xx", "xm", "sm", "mx", "ms", "mm")
_TILES = pa.schema([("tile", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in _NAMES]])


def column_origins(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """A present value of every column among its first rows (0 if there is
    none): no scan of the table."""
    found = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).limit(100).collect()
    out = []
    for i in range(len(cols)):
        held = [r[i] for r in found if r[i] is not None and np.isfinite(r[i])]
        out.append(held[0] if held else 0.0)
    return out


def gram_tiles(df: DataFrame, cols: Sequence[str], origins: Sequence[float]) -> DataFrame:
    """(tile, part, xx, xm, sm, mx, ms, mm): each task's share of the
    matrices X'X, X'M, (X*X)'M, their transposes and M'M, rows tile*TILE and
    on, as doubles in bytes.  Null, NaN and infinite values are missing."""
    p = len(cols)
    x = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def multiply(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - np.asarray(origins) if batch.num_rows else np.empty((0, p))
            m = np.isfinite(v)
            v = np.where(m, v, 0.0)
            m = m.astype(float)
            xm, sm = v.T @ m, (v * v).T @ m
            now = (v.T @ v, xm, sm, xm.T, sm.T, m.T @ m)
            total = now if total is None else tuple(a + b for a, b in zip(total, now))
        if total is not None:
            part = TaskContext.get().partitionId()
            for t in range(0, p, TILE):
                yield pa.RecordBatch.from_pydict({"tile": [t // TILE], "part": [part], **{n: [a[t:t + TILE].tobytes()] for n, a in zip(_NAMES, total)}}, _TILES)

    return x.mapInArrow(multiply, "tile int, part int, " + ", ".join(f"{n} binary" for n in _NAMES))


def pair_sums(df: DataFrame, cols: Sequence[str], origins: Sequence[float] | None = None) -> DataFrame:
    """One row per ordered pair of columns over the rows that hold both: i, j
    (places in ``cols``), n, sx and sxx of column i, sy and syy of column j,
    and sxy, all about the columns' origins.  A table without rows gives no
    pairs."""
    p = len(cols)
    origins = list(origins) if origins is not None else column_origins(df, cols)

    def finish(key, t):
        tile, t = key[0].as_py(), t.sort_by("part")
        sums = {n: sum(np.frombuffer(b.as_py(), float) for b in t.column(n)) for n in _NAMES}
        rows = len(sums["mm"]) // p
        return pa.table({"i": pa.array(np.repeat(np.arange(tile * TILE, tile * TILE + rows), p), pa.int32()), "j": pa.array(np.tile(np.arange(p), rows), pa.int32()),
                         "n": pa.array(sums["mm"].round().astype(np.int64)), "sx": sums["xm"], "sy": sums["mx"], "sxx": sums["sm"], "syy": sums["ms"], "sxy": sums["xx"]})

    return gram_tiles(df, cols, origins).groupBy("tile").applyInArrow(
        finish, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double")


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, corr) of every ordered pair of columns over its complete
    rows; null where one of the two does not vary there, and 1 for a column
    that varies with itself."""
    c = F.col
    vx, vy = c("n") * c("sxx") - c("sx") * c("sx"), c("n") * c("syy") - c("sy") * c("sy")
    varies = (vx > NOISE * c("n") * c("sxx")) & (vy > NOISE * c("n") * c("syy"))
    r = F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), F.sqrt(vx * vy))
    return pair_sums(df, cols).select("i", "j", "n", F.when(varies, F.when(c("i") == c("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))).alias("corr"))
