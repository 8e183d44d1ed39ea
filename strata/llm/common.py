"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import cut_lineage

#: FIXED VALUES: the white space that separates words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: Rows of one Arrow batch; whole texts ride in it, so it is kept small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to `rows` (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def whole_texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named extra columns; whatever else
    the table carries is dropped, so its names cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000):
    """Cut a batch into runs of rows of about `most` bytes of text (a longer
    text makes a run of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, used = 0, 0
    for i, n in enumerate(sizes):
        if used and used + n > most:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def merged(batches, column: str = "text", most: int = 8_000_000):
    """The rows of the batches again, in batches of about `most` bytes of text
    (a longer text makes a batch of its own)."""
    held, used = [], 0
    for batch in batches:
        for run in slices(batch, column, most):
            n = pc.sum(pc.binary_length(run.column(column))).as_py() or 0
            if held and used + n > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, used = [], 0
            if run.num_rows:
                held.append(run)
                used += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of the texts (A-Z lower-cased), flat, and
    the offsets of each text's words (one more than texts)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    return flat.filter(full), ends[offsets]


def key_groups(batches, key: str):
    """Tables of whole keys from sorted batches, with the rows at which a key
    begins and, last, their number."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        k = held.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(k)) + 1
        if not len(cuts):
            continue
        held = held.combine_chunks()
        yield held.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
        held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        k = held.column(key).to_numpy()
        yield held.combine_chunks(), np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [held.num_rows]])


def per_worker(key: str, make):
    """One object per Python worker process, kept from task to task (workers
    are reused); `make` builds it where the process has none yet."""
    store = sys.modules.setdefault("_strata_worker_store", types.ModuleType("_strata_worker_store"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


#: Ids up to which a list is broadcast (8 MB of longs); longer lists are shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs left_semi or left_anti the (written) list `ids` on doc_id.  The
    list is counted: up to BROADCAST_IDS ids go to every executor, and texts
    stay where they are; more are joined by a shuffle."""
    ids = ids.select("doc_id").distinct()
    if isinstance(ids.schema["doc_id"].dataType, T.NumericType) and ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how).select(*docs.columns)


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, written to the checkpoint folder and read in as few partitions as
    `rows` rows each need.  Small intermediate tables, which many steps read,
    then cost each of those steps a few files and not one per shuffle
    partition; large ones keep their partitions."""
    df = cut_lineage(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every id that has an edge: (id, component).

    Alternates large-star and small-star steps until every id points at one
    smaller id that points nowhere.  Each round is two grouped minima and two
    equi-joins; its edges are written to the checkpoint folder, and so are the
    minima that ids with many edges are joined with, so that such a join can
    be split.  Raises if it does not converge within `max_rounds` (the rounds
    grow with the logarithm of the number of ids).
    """
    e = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        once = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        if once and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not converge within {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
