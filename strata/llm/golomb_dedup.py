"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every block of rows (a sender) sorts the fingerprints of its texts and sends
them, cut by range, to their owners as Golomb-Rice coded gaps.  An owner
decodes what all senders sent, and answers each message with a bitmap of the
fingerprints that some other sender holds too.  Only the rows whose bit is
set, or that repeat inside their own block, are suspects; only suspects are
shuffled further, with their text, and are grouped by its bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SPACES, by_ids, whole_texts
from strata.session import cut_lineage

#: Rows of one sender block and fingerprints of one owner range, at most about.
BLOCK_ROWS_LOG2 = 18
OWNER_PRINTS_LOG2 = 18


def rice_encode(prints: np.ndarray, shift: int) -> bytes:
    """Sorted distinct unsigned integers as Golomb-Rice coded gaps with the
    divisor 2**shift: first the quotients in unary, then the remainders."""
    gaps = np.diff(prints.astype(np.uint64), prepend=np.uint64(0))
    high = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = np.zeros((len(gaps), shift), np.uint8)
    for j in range(shift):
        low[:, j] = (gaps >> np.uint64(shift - 1 - j)) & np.uint64(1)
    head = np.packbits(unary).tobytes()
    return len(head).to_bytes(8, "little") + head + np.packbits(low.ravel()).tobytes()


def rice_decode(data: bytes, n: int, shift: int) -> np.ndarray:
    """What `rice_encode` was given."""
    size = int.from_bytes(data[:8], "little")
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, 8))
    stops = np.flatnonzero(unary == 0)[:n]
    high = np.diff(stops, prepend=-1) - 1
    gaps = high.astype(np.uint64) << np.uint64(shift)
    if shift:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + size), count=n * shift).reshape(n, shift)
        for j in range(shift):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(shift - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _messages(prints: np.ndarray, width: int, owner_bits: int):
    """(owner, distinct sorted prints relative to the owner's range) of one block."""
    own, count = np.unique(prints, return_counts=True)
    owner = own >> np.uint64(width - owner_bits)
    cuts = np.flatnonzero(np.diff(owner, prepend=owner[:1] - np.uint64(1) if len(owner) else None)) if len(own) else []
    for start, stop in zip(cuts, [*cuts[1:], len(own)]):
        yield int(owner[start]), own[start:stop], count[start:stop] > 1


def _shift(n: int, span_bits: int) -> int:
    """Rice parameter for n prints spread over 2**span_bits."""
    return max(0, int(math.log2(max(1.0, math.log(2) * 2.0 ** span_bits / n))))


def suspect_rows(rows: DataFrame, extra_bits: int = 16) -> DataFrame:
    """`rows` (with a long `fingerprint`) plus `suspect`: some other row may
    hold the same fingerprint.  Rows that share a fingerprint are all
    suspects; another row is one with a chance of about 2**-extra_bits.

    The fingerprint is cut to log2(rows) + extra_bits bits, so what travels
    for a row is about extra_bits + 2 bits.  Blocks and owner ranges hold a
    bounded number of fingerprints; a fingerprint that many rows share is
    sent once per block.
    """
    spark = rows.sparkSession
    names = rows.columns
    rows = cut_lineage(rows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS_LOG2)))
    total = rows.count()
    width = min(62, max(1, math.ceil(math.log2(max(2, total)))) + extra_bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = min(width, max(math.ceil(math.log2(max(1, total))) - OWNER_PRINTS_LOG2, math.ceil(math.log2(2 * parts))))
    span = width - owner_bits
    rows = rows.withColumn("_print", F.shiftrightunsigned(F.col("fingerprint"), 64 - width))

    def send(batches):
        block, held = None, []

        def flush():
            for owner, own, _ in _messages(np.concatenate(held).astype(np.uint64), width, owner_bits):
                rel = own - (np.uint64(owner) << np.uint64(span))
                shift = _shift(len(rel), span)
                yield pa.RecordBatch.from_pydict({
                    "_block": pa.array([block], pa.int64()), "owner": pa.array([owner], pa.int64()),
                    "n": pa.array([len(rel)], pa.int32()), "shift": pa.array([shift], pa.int32()),
                    "payload": pa.array([rice_encode(rel, shift)], pa.binary())})

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy()
            for b in np.unique(blocks):
                if block is not None and b != block:
                    yield from flush()
                    held = []
                block = int(b)
                held.append(prints[blocks == b])
        if held:
            yield from flush()

    messages = rows.select("_block", "_print").mapInArrow(send, "_block long, owner long, n int, shift int, payload binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [rice_decode(p, n, s) for p, n, s in zip(pdf["payload"], pdf["n"], pdf["shift"])]
        every, count = np.unique(np.concatenate(sent), return_counts=True)
        shared = every[count > 1]
        maps = []
        for one in sent:
            at = np.searchsorted(shared, one)
            hit = np.zeros(len(one), bool) if not len(shared) else shared[np.minimum(at, len(shared) - 1)] == one
            maps.append(np.packbits(hit).tobytes())
        return pd.DataFrame({"_block": pdf["_block"], "owner": pdf["owner"], "bitmap": maps})

    bitmaps = messages.groupBy("owner").applyInPandas(answer, "_block long, owner long, bitmap binary")
    bitmaps = bitmaps.filter(F.length("bitmap") > 0)

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        prints = left["_print"].to_numpy().astype(np.uint64)
        answers = dict(zip(right["owner"], right["bitmap"]))
        found = [np.empty(0, np.uint64)]
        for owner, own, twice in _messages(prints, width, owner_bits):
            hit = twice.copy()
            if owner in answers:
                hit |= np.unpackbits(np.frombuffer(answers[owner], np.uint8), count=len(own)).astype(bool)
            found.append(own[hit])
        out = left.drop(columns=["_block", "_print"])
        out["suspect"] = np.isin(prints, np.concatenate(found))
        return out

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*names).dtypes) + ", suspect boolean"
    return rows.groupBy("_block").cogroup(bitmaps.groupBy("_block")).applyInPandas(mark, schema)


def exact_dedup(docs: DataFrame, extra_bits: int = 16) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256, suspect.

    Texts are equal when identical after deleting every character of
    [\\x20\\x09-\\x0D]; a null text counts as empty, so null, empty and blank
    texts form one group.  Of equal texts the row with the most code points,
    then the smallest doc_id, stays.  Rows that repeat a doc_id with an equal
    text share its fate and each counts in group_size.  A null doc_id stays
    only where its group has no other id.  No rows in, no rows out; columns
    other than doc_id and text are ignored.

    Raises if two different byte strings carry one SHA-256 among the suspects.
    """
    docs = whole_texts(docs)
    norm = F.translate("text", SPACES, "")
    rows = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64(norm).alias("fingerprint"),
                       F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    rows = cut_lineage(suspect_rows(rows, extra_bits))
    suspects = rows.filter("suspect")

    # byte verification: equal texts meet as one key of a partial aggregate, so a hot text shrinks before the shuffle
    texts = by_ids(docs, suspects, "left_semi").select(norm.alias("norm"))
    forms = texts.groupBy("norm").agg(F.count("*").alias("n")).select(F.sha2(F.col("norm").cast("binary"), 256).alias("h"))
    clash = forms.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two different texts share the SHA-256 {clash[0]['h']}")

    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("best")
    classes = cut_lineage(suspects.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best)
                          .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id")))
    grouped = suspects.join(classes, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256", "suspect")
    alone = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                              "text_sha256", "suspect")
    every = grouped.unionByName(alone)
    return every.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "suspect")
