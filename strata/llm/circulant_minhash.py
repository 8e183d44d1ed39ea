"""Near-duplicate documents by circulant MinHash.

Two permutations of one universe make every signature: the first scatters a
document's shingles, the second, shifted circularly by k, gives coordinate k,
so all coordinates of a shingle are one run of the second permutation.  Bands
of the signature propose documents; every link is confirmed on the full
shingle sets.  Documents with equal sets are one class from the start.

In a band's bucket not all pairs are formed.  First one hub per bucket, the
member that shares buckets most, is tested against the other members; buckets
whose members are then all connected drop out.  In the others, members that
are still apart are tested against all members that they are apart from: pair
by pair in small buckets, and large buckets, which overlap, by blocks of the
documents they hold together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import by_ids, connected_components, settled, slices, whole_texts, words_of
from strata.session import cut_lineage

#: FIXED VALUES: words of a shingle; a link has 100 * intersection >= PERCENT * union.
SHINGLE = 5
PERCENT = 75

#: Bands and rows of a band: a pair at the threshold shares a band with a chance of 1 - (1 - 0.75**4)**32 = 0.999995.
BANDS, ROWS = 32, 4
UNIVERSE_LOG2 = 20
#: Members of a bucket up to which its pairs are tested one by one.
SMALL_BUCKET = 64
#: Documents of one block, and shingles that it holds about.
BLOCK, BLOCK_SHINGLES = 500, 200_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array):
    """The sorted distinct 64-bit shingle hashes of each text: of every five
    words running, of the whole sequence where there are fewer, none without
    words."""
    import xxhash

    words, offsets = words_of(texts)
    coded = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = hashes[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    n = max(0, len(w) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        runs += w[j:j + n] * _MULTIPLIERS[j]
    runs = _mix(runs)
    for d in range(len(texts)):
        start, stop = offsets[d], offsets[d + 1]
        if stop - start >= SHINGLE:
            yield np.unique(runs[start:stop - SHINGLE + 1])
        elif stop > start:
            k = int(stop - start)
            yield _mix((w[start:stop] * _MULTIPLIERS[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k))
        else:
            yield np.empty(0, np.uint64)


class Circulant:
    """The two permutations; `bands` of a set of shingles."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 3):
        rng = np.random.default_rng(seed)
        size, self.coordinates = 1 << UNIVERSE_LOG2, bands * rows
        self.scatter = rng.permutation(size).astype(np.uint32)
        second = rng.permutation(size).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:self.coordinates]]), self.coordinates)
        self.shape = bands, rows
        self.multipliers = _mix(np.arange(1, self.coordinates + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles >> np.uint64(64 - UNIVERSE_LOG2)).astype(np.int64)]
        low = np.full(self.coordinates, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(at), 1024):
            np.minimum(low, self.shifted[at[k:k + 1024]].min(axis=0), out=low)
        return low

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(self.shape).astype(np.uint64) + np.uint64(1)
        return _mix((rows * self.multipliers).sum(axis=1, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set, null if empty)
    and the band keys of every row of `docs`."""
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        circulant = Circulant(bands, rows)
        for batch in batches:
            for part in slices(batch, most=2_000_000):
                size, key, band = [], [], []
                for s in shingle_sets(part.column("text")):
                    size.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    band.append(circulant.bands(s) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                                                  pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id and the shingle set of every row of `docs`."""
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=1_000_000):
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(run, f"id {kind}, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"),
                                                        (F.size("sa") + F.size("sb")).alias("n"))
    return both.filter(f"100 * cast(i as long) >= {percent} * (n - i)").select("a", "b").distinct()


def _apart(live: DataFrame, component: DataFrame) -> DataFrame:
    """Members (key, id, n, m, label) of the buckets whose members are not all
    in one component, with the bucket's largest component as `main`."""
    labelled = live.join(component.withColumnRenamed("component", "label"), "id", "left")
    labelled = settled(labelled.select("key", "id", "n", "m", F.coalesce("label", "id").alias("label")))
    per = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    main = settled(main.select("key", F.col("top.label").alias("main")))
    return settled(labelled.join(main, "key"))


def block_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members (cluster, id, n, label) of one cluster and
    different labels: for every document outside its cluster's largest label
    at least one link to each label it has links to.  All those documents are
    compared with all of the cluster, a block against a block, by exact
    intersections of the full sets."""
    main = members.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("top"))
    members = members.join(settled(main.select("cluster", F.col("top.label").alias("main"))), "cluster").withColumn("far", F.col("label") != F.col("main"))

    def blocks(of):
        count, held = F.sum(F.when(of, 1).otherwise(0)), F.sum(F.when(of, F.col("n")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(held / BLOCK_SHINGLES)).cast("int")

    shape = settled(members.groupBy("cluster").agg(blocks(F.col("far")).alias("far_blocks"), blocks(F.lit(True)).alias("all_blocks")))
    rows = members.join(shape, "cluster").join(sets, "id")
    hashed = F.xxhash64("id", F.lit(17))
    far = rows.filter("far").select("cluster", F.pmod(hashed, F.col("far_blocks")).cast("int").alias("x"), F.explode(F.expr("sequence(0, all_blocks - 1)")).alias("y"),
                                    F.lit(0).alias("side"), "id", "label", "shingles")
    every = rows.select("cluster", F.explode(F.expr("sequence(0, far_blocks - 1)")).alias("x"), F.pmod(hashed, F.col("all_blocks")).cast("int").alias("y"),
                        F.lit(1).alias("side"), "id", "label", "shingles")
    kind = dict(members.dtypes)["id"]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"], kind="stable")
        size = pdf["shingles"].map(len).to_numpy()
        n = int((pdf["side"] == 0).sum())
        owner = np.repeat(np.arange(len(pdf)), size)
        _, column, count = np.unique(np.concatenate([np.empty(0, np.int64), *pdf["shingles"]]), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], column[shared]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        inter = np.zeros((n, len(pdf) - n), np.float32)
        column = np.unique(column, return_inverse=True)[1]
        for k in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, [k, k + 4096])
            x = np.zeros((len(pdf), 4096), np.float32)
            x[owner[a:b], column[a:b] - k] = 1
            inter += x[:n] @ x[n:].T
        label = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
        linked = 100 * inter >= percent * (size[:n, None] + size[None, n:] - inter)
        linked &= label[:n, None] != label[None, n:]
        ids, out = pdf["id"].to_numpy(), []
        for i in np.flatnonzero(linked.any(axis=1)):
            to = np.flatnonzero(linked[i])
            for j in to[np.unique(label[n + to], return_index=True)[1]]:
                out.append((ids[i], ids[n + j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": ids.dtype, "b": ids.dtype})

    return far.union(every).groupBy("cluster", "x", "y").applyInPandas(verify, f"a {kind}, b {kind}")


def near_components(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles,
    component_id (smallest doc_id reachable by links), kept.

    A null or blank text has no shingles and links with nothing.  Rows with a
    null doc_id cannot be named: one whose set equals that of a named row
    joins that row's component and is not kept; else its component_id is null
    and it is kept.  Rows that repeat a doc_id are one node.  No rows in, no
    rows out; other columns are ignored.
    """
    sketched = cut_lineage(sketch(docs, bands, rows))
    classes = settled(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id")))
    reps = sketched.join(classes, (sketched["set_key"] == classes["set_key"]) & (sketched["doc_id"] == classes["id"]), "left_semi")
    members = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("m")).filter("x <> y")
    live = settled(members.join(settled(shared.select("key", "m")), "key").distinct())
    sets = settled(full_sets(by_ids(docs, live.select(F.col("id").alias("doc_id")), "left_semi")).dropDuplicates(["id"]), 2000)

    similar_size = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    # one hub per bucket, the same in the buckets it shares
    often = settled(live.groupBy("id").agg(F.sum("m").alias("often")))
    hubs = live.join(often, "id").groupBy("key").agg(F.min(F.struct(-F.col("often"), F.col("id"), F.col("n"))).alias("t"))
    hubs = settled(hubs.select("key", F.col("t.id").alias("x"), F.col("t.n").alias("na")))
    other = live.select("key", F.col("id").alias("y"), F.col("n").alias("nb"))
    tested = settled(hubs.join(other, "key").filter(f"x <> y and {similar_size}").select(*pair).distinct())
    component = settled(connected_components(confirmed(tested, sets, percent)))

    apart = _apart(live, component)
    large = apart.filter(F.col("m") > small_bucket)
    stars = large.join(settled(large.groupBy("key").agg(F.min("id").alias("x"))), "key")
    cluster = settled(connected_components(stars.select(F.col("x").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "cluster"))
    small = apart.filter(F.col("m") <= small_bucket).join(cluster, "id", "left")
    one = small.filter("label <> main").select("key", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("na"), F.col("cluster").alias("cx"))
    other = small.select("key", F.col("id").alias("y"), F.col("label").alias("ly"), F.col("n").alias("nb"), F.col("cluster").alias("cy"))
    pairs = one.join(other, "key").filter(f"lx <> ly and {similar_size} and (cx = cy) is not true").select(*pair).distinct()
    pairs = settled(pairs.join(tested, ["a", "b"], "left_anti"))
    clustered = large.select("id", "n", "label").distinct().join(cluster, "id")
    # what is connected already is carried on as one link per document
    known = component.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = confirmed(pairs, sets, percent).union(block_links(clustered, sets, percent)).union(known)
    component = settled(connected_components(found))

    classes = classes.join(component, "id", "left")
    named = cut_lineage(classes.select("set_key", F.coalesce("component", "id").alias("component_id")))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))
