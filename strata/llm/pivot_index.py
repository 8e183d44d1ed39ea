"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots.  Vectors of
one label that share at least two of their first pivots are candidates: the
inverted lists are kept per pair of pivots, so that two vectors meet exactly
in the lists of the pairs they share, and the number of shared pivots is known
from the prefixes.  Candidates are verified by cosine in double precision,
each pair in the first list it shares and in no other.  A long list is cut
into blocks, and pairs of blocks are verified separately, as matrix products;
only per-vector counts and a spanning set of links leave a block, never all
pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import connected_components, key_groups
from strata.session import cut_lineage

#: FIXED VALUE: the smallest cosine of a link.
COSINE = 0.93

#: Pivots per square root of the number of vectors, and the fitted sample's bound at any size.
PIVOTS_PER_ROOT, MOST_PIVOTS = 2.0, 100_000
#: Pivots whose cosine is above this describe the same place; the later one is left out.
PIVOT_APART = 0.8
#: Length of a vector's prefix of nearest pivots, of which two must be shared.
PREFIX = 6
#: Vectors of one block of an inverted list.
BLOCK = 1000


def unit(rows: list) -> np.ndarray:
    """Vectors scaled to length 1 in double precision (first by their largest
    component, so that nothing under- or overflows)."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(distinct: DataFrame, total: int, per_root: float = PIVOTS_PER_ROOT) -> dict[int, np.ndarray]:
    """Pivots by dimension: a bounded sample, the vectors that come first by a
    hash of their id, without those close to an earlier one."""
    most = min(MOST_PIVOTS, max(8, math.ceil(per_root * math.sqrt(total))))
    sample = distinct.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(2 * most).select("dim", "vector").toPandas()
    pivots = {}
    for dim, own in sample.groupby("dim"):
        x = unit(list(own["vector"]))
        kept = np.zeros((0, x.shape[1]))
        for k in range(0, len(x), 256):
            some = x[k:k + 256]
            for v in some[(some @ kept.T).max(axis=1, initial=-1) < PIVOT_APART]:
                if (kept[-256:] @ v).max(initial=-1) < PIVOT_APART:
                    kept = np.vstack([kept, v])
        pivots[int(dim)] = kept[:most]
    return pivots


def inverted_lists(distinct: DataFrame, pivots: dict[int, np.ndarray], prefix: int = PREFIX) -> DataFrame:
    """label, dim, p, q, id, size, prefix, unit: every vector, scaled to
    length 1 (as bytes of doubles), once for each pair p < q of its `prefix`
    nearest pivots.  With fewer than two pivots there is one list per label."""
    def post(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            rows = batch.column("vector").to_pylist()
            scaled: list = [None] * len(rows)
            at, ps, qs, pre = [], [], [], []
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                own = unit([rows[i] for i in mine])
                for i, v in zip(mine, own):
                    scaled[i] = v.tobytes()
                piv = pivots.get(int(dim), np.zeros((0, int(dim))))
                n = min(prefix, len(piv))
                if n < 2:
                    at.append(mine)
                    ps.append(np.full(len(mine), -1, np.int32))
                    qs.append(np.full(len(mine), -1, np.int32))
                    pre.append([np.full(2, -1, np.int32).tobytes()] * len(mine))
                    continue
                near = own @ piv.T
                first = np.argpartition(-near, n - 1, axis=1)[:, :n]
                order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
                first = np.take_along_axis(first, order, 1).astype(np.int32)
                low = np.sort(first, axis=1)
                for a, b in combinations(range(n), 2):
                    at.append(mine)
                    ps.append(low[:, a])
                    qs.append(low[:, b])
                    pre.append([f.tobytes() for f in first])
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("label", "dim", "id", "size")]
                + [pa.array(np.concatenate(ps)), pa.array(np.concatenate(qs)), pa.array([x for own in pre for x in own], pa.binary()), pa.array(scaled, pa.binary()).take(take)],
                names=["label", "dim", "id", "size", "p", "q", "prefix", "unit"])

    types = dict(distinct.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("label", "dim", "id", "size")) + ", p int, q int, prefix binary, unit binary"
    return distinct.select("label", "dim", "id", "size", "vector").mapInArrow(post, schema)


def verify_blocks(lists: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """id, links (weighted by `size` of the linked vectors), other (the first
    vector of its linked group in the block): one row per block and linked
    vector."""
    key = ["label", "dim", "p", "q"]
    long = cut_lineage(lists.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")))
    held = lists.join(long.drop("m"), key)
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    # block pairs (x, y), x <= y: a vector of block b goes to every pair that has b
    held = held.withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("x", F.least("b", "o")).withColumn("y", F.greatest("b", "o")).withColumn("g", F.xxhash64(*key, "x", "y"))
    held = held.repartition(*key, "x", "y").sortWithinPartitions("g", *key, "x", "y", "id")
    kind = dict(lists.dtypes)["id"]

    def one(p, q, mixed, vec, size, side, pre):
        """(rows with links, their weighted number, first row of their group)."""
        linked = vec @ vec.T >= cosine
        np.fill_diagonal(linked, False)
        if mixed:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        # this is the pair's first shared list unless it also shares a lower pivot
        other = (pre < q) & (pre != p)
        lower = np.unique(pre[other])
        if len(lower):
            has = np.zeros((len(vec), len(lower)), np.float32)
            rows, cols = np.nonzero(other)
            has[rows, np.searchsorted(lower, pre[rows, cols])] = 1
            linked &= has @ has.T == 0
        root = np.arange(len(vec))
        while True:
            low = np.minimum(root, np.where(linked, root[None, :], len(vec)).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        count = linked @ size
        on = np.flatnonzero(count)
        return on, count[on], root[on]

    def verify(batches):
        for table, cuts in key_groups(batches, "g"):
            ids = table.column("id").combine_chunks()
            p, q, x, y, b, dim, size = (table.column(c).to_numpy() for c in ("p", "q", "x", "y", "b", "dim", "size"))
            unit_, prefix = table.column("unit").to_pylist(), table.column("prefix").to_pylist()
            at, links, other = [], [], []
            for i, j in zip(cuts[:-1], cuts[1:]):
                got = one(p[i], q[i], x[i] != y[i], np.frombuffer(b"".join(unit_[i:j])).reshape(j - i, dim[i]), size[i:j], b[i:j],
                          np.frombuffer(b"".join(prefix[i:j]), np.int32).reshape(j - i, -1)) if j - i > 1 else None
                if got:
                    at.append(i + got[0])
                    links.append(got[1])
                    other.append(i + got[2])
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(links).astype(np.int64)),
                                                  ids.take(pa.array(np.concatenate(other)))], names=["id", "links", "other"])

    return held.select("g", "id", "size", "p", "q", "x", "y", "b", "dim", "prefix", "unit").mapInArrow(verify, f"id {kind}, links long, other {kind}")


def vector_links(vectors: DataFrame, cosine: float = COSINE, per_root: float = PIVOTS_PER_ROOT, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id,
    n_links, component_id, kept.

    Vectors are compared only when their labels are equal and not null and
    their lengths agree.  Null, empty and zero vectors, those with null or
    non-finite components and those without a label link with nothing; so do
    rows with a null vec_id, whose component_id is null.  Equal vectors of one
    label are one class, linked among themselves; rows that repeat a vec_id
    with it count as further vectors.  No rows in, no rows out; other columns
    are ignored.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    clean = usable & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    vector = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select("vec_id", "label", F.when(clean, vector).alias("vector"))
    rows = cut_lineage(rows.withColumn("content", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))))
    good = rows.filter("vector is not null")
    distinct = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    distinct = cut_lineage(distinct.withColumn("dim", F.size("vector")))
    total = distinct.count()
    lists = inverted_lists(distinct, choose_pivots(distinct, total, per_root), prefix)
    found = cut_lineage(verify_blocks(lists, cosine, block))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = distinct.join(links, "id", "left").join(component, "id", "left")
    classes = cut_lineage(classes.select("label", "vector", F.xxhash64("label", "vector").alias("content"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                                         F.coalesce("component", "id").alias("component_id")))
    # equal content hashes meet, equal contents join; the hash spares the shuffle a sort by whole vectors
    both = rows.alias("r").join(classes.alias("c"), F.expr("r.content = c.content and r.label = c.label and r.vector = c.vector"), "left")
    out = both.select("r.vec_id", F.coalesce("c.n", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("c.component_id", "r.vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
