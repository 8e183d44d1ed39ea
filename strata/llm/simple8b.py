"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its upper four bits and as many ids as fit
the other sixty at the selector's width.  A value of more than sixty bits is
an escape: its word holds its place in a table of whole values.  Ids are coded
in blocks of BLOCK, each of which begins a word of its own, and the file keeps
every block's first word; so all words are decoded at once, and any block
without those before it.

A file holds whole documents in ascending order, little-endian throughout:

    b"S8B1", uint32 BLOCK, uint64 documents, ids, words, escapes
    int64[documents]       document ids (0 where there is none)
    uint8[documents]       1 where the document has an id, padded to 8 bytes
    uint64[documents]      ids up to the end of each document
    uint64[blocks + 1]     first word of each block, and their number
    uint64[words]
    uint64[escapes]
    uint32 crc32 of all that, uint32 0
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import merged, per_worker, whole_texts
from strata.llm.text_chunks import ByteLevel, ChunkTable, chunks_of
from strata.session import cut_lineage
from strata.sources.io import output_path

#: FIXED VALUES: how many ids a word of each selector holds, and their bits; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)

#: Ids of a block, and of a file before the next document begins a new one.
BLOCK = 1024
FILE_IDS = 4_000_000

#: Ids that are packed at once (whole blocks).
PACK_IDS = 256 * BLOCK

#: FIXED VALUE: the id that ends a document.
END_ID = 2

MAGIC = b"S8B1"
_PAYLOAD = np.uint64((1 << 60) - 1)
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)


# -- words ------------------------------------------------------------------------

def _selectors(need: np.ndarray) -> np.ndarray:
    """The selector of the longest word that could begin at each place of each
    row: `need` has the least selector of every id (one beyond the last for an
    escape, which stands by itself), and 1 where a row is past its end (any
    word covers that)."""
    rows, most = need.shape[0], int(COUNTS.max())
    padded = np.ones((rows, need.shape[1] + most), np.uint8)
    padded[:, :need.shape[1]] = need
    width = need.shape[1]
    top = {1: padded}     # the largest need among so many places from each one on

    def wider(n: int) -> np.ndarray:
        if n not in top:
            half = (n + 1) // 2
            a = wider(half)
            top[n] = np.maximum(a[:, :a.shape[1] - (n - half)], a[:, n - half:])
        return top[n]

    out = np.zeros(need.shape, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = wider(int(COUNTS[s]))[:, :width] <= s
        out[fits] = s
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n, blocks = len(ids), -(-len(ids) // block)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grid = np.zeros((blocks, block), np.uint64)
    grid.ravel()[:n] = ids
    need = (np.searchsorted(_LIMITS, grid.ravel(), side="right") + 1).astype(np.uint8).reshape(blocks, block)
    chosen = _selectors(need)
    step = COUNTS[chosen]
    length = np.full(blocks, block, np.int64)
    length[-1] = n - (blocks - 1) * block
    begins = np.zeros((blocks, block), bool)
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        begins[row, at] = True
        at = at + step[row, at]
        more = at < length[row]
        row, at = row[more], at[more]
    place = np.flatnonzero(begins.ravel())
    selector = chosen.ravel()[place]
    padded = np.zeros((blocks, block + int(COUNTS.max())), np.uint64)
    padded[:, :block] = grid
    flat, from_ = padded.ravel(), place // block * padded.shape[1] + place % block
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if len(mine) and WIDTHS[s]:
            own = np.zeros(len(mine), np.uint64)
            for j in range(int(COUNTS[s])):
                own |= flat[from_[mine] + j] << (np.uint64(j) * WIDTHS[s])
            words[mine] |= own
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    per_block = np.bincount(place // block, minlength=blocks)
    return words, np.cumsum(per_block) - per_block, flat[from_[escaped]]


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of whole blocks of words (`first`: their first words)."""
    blocks = len(first)
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    before = np.cumsum(held) - held
    per_block = np.diff(np.append(first, len(words)))
    wide = block + int(COUNTS.max())
    # each block is decoded into a row of its own, with room for what its last word holds beyond it
    at = before - np.repeat(before[first], per_block) + np.repeat(np.arange(blocks) * wide, per_block)
    out = np.zeros(blocks * wide, np.uint64)
    payload = words & _PAYLOAD
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if len(mine) and WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(int(COUNTS[s])):
                out[at[mine] + j] = (payload[mine] >> (np.uint64(j) * WIDTHS[s])) & mask
    mine = np.flatnonzero(selector == 0)
    out[at[mine]] = escapes[payload[mine].astype(np.int64)]
    return out.reshape(blocks, wide)[:, :block].ravel()[:n]


# -- files ------------------------------------------------------------------------

@dataclass
class Shard:
    """What a file holds; ids are decoded on demand."""

    doc_ids: np.ndarray
    named: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    words: np.ndarray
    escapes: np.ndarray
    block: int

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids start to stop of the file, from the blocks that hold them."""
        n = int(self.ends[-1]) if len(self.ends) else 0
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.empty(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        lo, hi = int(self.first[a]), int(self.first[b])
        got = unpack(self.words[lo:hi], self.first[a:b].astype(np.int64) - lo, self.escapes, min(n, b * self.block) - a * self.block, self.block)
        return got[start - a * self.block:stop - a * self.block]


class ShardWriter:
    """Collects documents and packs their ids block by block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.doc_ids, self.named, self.ends, self.n = [], [], [], 0
        self.rest = np.empty(0, np.uint64)
        self.words, self.first, self.escapes, self.n_words, self.n_escapes = [], [], [], 0, 0

    def add(self, doc_ids: np.ndarray, named: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.named.append(named)
        self.ends.append(self.n + np.cumsum(sizes))
        self.n += int(sizes.sum())
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // self.block * self.block
        self._pack(ids[:whole])
        self.rest = ids[whole:]

    def _pack(self, ids: np.ndarray) -> None:
        step = PACK_IDS // self.block * self.block
        for at in range(0, len(ids), step):
            words, first, escapes = pack(ids[at:at + step], self.block)
            words[(words >> np.uint64(60)) == 0] += np.uint64(self.n_escapes)
            self.words.append(words)
            self.first.append(first + self.n_words)
            self.escapes.append(escapes)
            self.n_words += len(words)
            self.n_escapes += len(escapes)

    def content(self) -> bytes:
        self._pack(self.rest)
        self.rest = np.empty(0, np.uint64)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        doc_ids = join(self.doc_ids, "<i8")
        named = join(self.named, np.uint8)
        body = b"".join([
            MAGIC, np.array([self.block], "<u4").tobytes(), np.array([len(doc_ids), self.n, self.n_words, self.n_escapes], "<u8").tobytes(),
            doc_ids.tobytes(), named.tobytes().ljust(-(-len(named) // 8) * 8, b"\0"), join(self.ends, "<u8").tobytes(),
            np.append(join(self.first, "<u8"), np.array([self.n_words], "<u8")).astype("<u8").tobytes(), join(self.words, "<u8").tobytes(),
            join(self.escapes, "<u8").tobytes()])
        return body + np.array([zlib.crc32(body), 0], "<u4").tobytes()


def read_shard(content: bytes | pa.Buffer) -> Shard:
    """The shard in a file's bytes; raises ValueError where they are none."""
    content = memoryview(content)
    if len(content) < 48 or bytes(content[:4]) != MAGIC:
        raise ValueError("not a Simple-8b file")
    if zlib.crc32(content[:-8]) != int(np.frombuffer(content, "<u4", 1, len(content) - 8)[0]):
        raise ValueError("this Simple-8b file is damaged")
    block = int(np.frombuffer(content, "<u4", 1, 4)[0])
    docs, n, words, escapes = map(int, np.frombuffer(content, "<u8", 4, 8))
    at = 40

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(content, kind, count, at)
        at += -(-got.nbytes // 8) * 8
        return got

    doc_ids, named, ends = part("<i8", docs), part("u1", docs), part("<u8", docs)
    first = part("<u8", -(-n // block) + 1)
    return Shard(doc_ids, named, ends, first, part("<u8", words), part("<u8", escapes), block)


# -- Spark ------------------------------------------------------------------------

class _Ids:
    """ids of whole texts, through the worker's table of chunks."""

    def __init__(self, tokenizer_json: str):
        self.coder = ByteLevel(tokenizer_json)
        self.table = ChunkTable(lambda chunks: {"ids": self.coder.encode(chunks)})

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, flat; number of ids of each)."""
        chunks, offsets = chunks_of(texts)
        rows = self.table.rows(chunks)
        ids, size = self.table.take("ids", rows)
        sizes = np.diff(np.concatenate([[0], np.cumsum(size)])[offsets])
        special = self._with_special(texts)
        if len(special):
            found = [e.ids for e in self.coder.whole.encode_batch_fast([texts[int(d)].as_py() for d in special], add_special_tokens=False)]
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for d, own in zip(special, found):
                parts[d], sizes[d] = np.array(own, ids.dtype), len(own)
            ids = np.concatenate(parts)
        return ids, sizes

    def _with_special(self, texts: pa.Array) -> np.ndarray:
        """Texts that hold a special token's string, which may part them where
        no chunk ends."""
        has = np.zeros(len(texts), bool)
        for s in self.coder.special:
            has |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return np.flatnonzero(has)


def _store(folder: str):
    """(Arrow file system, path) of a folder given as a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Write the ids of every whole text of `docs` (doc_id, text), each
    followed by `end_id`, to Simple-8b files in `folder`, in ascending order
    of doc_id, and return the list of files: file, documents, ids, and start,
    the ids in all files before it.

    `folder` is a path or URI that all executors can write (file, hdfs, s3,
    gs, ...).  doc_id must be an integer.  A null text counts as empty: its
    document is the end id alone.  Null doc_ids come first; rows that repeat a
    doc_id are ordered by a hash of their text and each is a document.  An
    empty table gives no files.  Other columns are ignored.  A file is written
    under another name and then renamed, so a task that is run again replaces
    it by the same bytes.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("token files are ordered by an integer doc_id")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"),
                                    F.monotonically_increasing_id().alias("_n"))
    # equal rows differ in _n, so that no key is too large for a range
    ordered = rows.repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")

    def write(batches):
        coder = per_worker(f"simple8b_{zlib.crc32(tokenizer_json.encode())}", lambda: _Ids(tokenizer_json))
        store, path = _store(folder)
        part, writer, files = TaskContext.get().partitionId(), ShardWriter(block), 0

        def close():
            nonlocal writer, files
            name = f"part-{part:06d}-{files:05d}.s8b"
            own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(writer.content())
            store.move(own, f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "documents": [sum(map(len, writer.doc_ids))], "ids": [writer.n]}, names)
            writer, files = ShardWriter(block), files + 1
            return row

        for run in merged(batches, most=4_000_000):
            found, sizes = coder.of(run.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(found, ends, end_id)
            sizes = sizes + 1
            doc_ids = run.column("doc_id")
            named = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            doc_ids = doc_ids.fill_null(0).to_numpy()
            begin, ends = 0, np.cumsum(sizes)
            while begin < len(sizes):
                # documents that still go into this file
                upto = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, upto + file_ids - writer.n, side="right")))
                writer.add(doc_ids[begin:stop], named[begin:stop], sizes[begin:stop], ids[upto:int(ends[stop - 1])])
                begin = stop
                if writer.n >= file_ids or begin < len(sizes):
                    yield close()
        if writer.n:
            yield close()

    names = pa.schema([("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
    files = cut_lineage(ordered.mapInArrow(write, "file string, documents long, ids long"))
    # starts: sums over tasks, then over the files of a task
    task = F.substring("file", 6, 6).cast("int")
    per_task = files.groupBy(task.alias("_task")).agg(F.sum("ids").alias("_ids"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)      # one row per task
    base = per_task.select("_task", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    here = Window.partitionBy("_task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("_task", task).join(base, "_task").withColumn("start", F.col("_base") + F.coalesce(F.sum("ids").over(here), F.lit(0)))
    return cut_lineage(listed.select("file", "documents", "ids", "start"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One row per document of the listed files (`files`, as
    `write_token_files` returns them): doc_id, start (ids of all documents
    before it), n_tokens, ids (unless dropped by `keep_ids`) and ids_crc32,
    the unsigned crc32 of its ids as little-endian unsigned 32-bit integers.
    Files that are not listed are passed over; a damaged one is an error."""
    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content")):
                shard = read_shard(content.as_buffer())
                ends = shard.ends.astype(np.int64)
                # documents in runs of about a million ids, so that few are decoded at once
                cuts = np.unique(np.append(np.searchsorted(ends, np.arange(1, int(ends[-1]) // 1_000_000 + 1) * 1_000_000), len(ends)))
                begin = 0
                for stop in cuts[cuts > 0].tolist():
                    lo, hi = int(ends[begin - 1]) if begin else 0, int(ends[stop - 1])
                    ids = shard.ids(lo, hi).astype("<u4")
                    at = np.concatenate([[lo], ends[begin:stop]]) - lo
                    crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                    doc_ids = pa.array(shard.doc_ids[begin:stop], mask=shard.named[begin:stop] == 0)
                    cols = [pa.array([name.as_py()] * (stop - begin)), doc_ids, pa.array(lo + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if keep_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    begin = stop

    names = ["file", "doc_id", "_at", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = ["string", "long", "long", "long", "long", *(["array<long>"] if keep_ids else [])]
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    held = held.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    got = held.mapInArrow(read, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    got = got.join(files.select("file", F.col("start").alias("_start")), "file")
    return got.select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", *(["ids"] if keep_ids else []), "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Write `docs` to Simple-8b files (a fresh folder beside the checkpoints
    by default) and read them back; see `write_token_files` and
    `read_token_files`.  No documents give no rows."""
    spark = docs.sparkSession
    folder = folder or output_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer_path, folder), keep_ids)
