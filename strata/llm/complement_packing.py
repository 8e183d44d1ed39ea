"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents are tokenised in tasks and cut into pieces.  How pieces are
combined depends only on how many pieces of each length there are, a table of
at most `capacity` counts: the plan is made from it.  Combinations of one,
two or three lengths whose sum fills a gap exactly are taken first, as often
as their counts allow; what is left goes best-fit.  Every piece then finds its
place from its length and its rank among the pieces of that length, which
comes from per-task ranks and a prefix sum over tasks.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import merged, per_worker, whole_texts, words_of
from strata.session import cut_lineage

#: FIXED VALUES: tokens of a sequence, and the id that ends a document.
CAPACITY = 2048
END_ID = 0

#: FIXED VALUE: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words and parts of words that a worker process keeps with their ids before it forgets those met once.
WORD_TABLE = 600_000


class WordTable:
    """ids of distinct words, filled as words come; white space is dropped by
    the tokenizer and nothing merges across it, so a text's ids are those of
    its words in order."""

    #: FIXED VALUE: a special token of the vocabulary, used to part words.
    MARK, MARK_ID = "<|endoftext|>", 49407

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if self.tokenizer.token_to_id(self.MARK) != self.MARK_ID:
            raise ValueError(f"the vocabulary has no {self.MARK} with id {self.MARK_ID}")
        self.model = self.tokenizer.model
        # what the byte-level step makes of the letters below U+0100
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.words = pa.array([""], pa.string())
        self.first, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.hits = np.zeros(1, np.int32)   # batches that held the word

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of the words, -1 for those the table lacks."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _forget(self) -> None:
        """Keep the words that more than one batch held, at most half a table
        of them, and halve their counts."""
        least = max(2, int(np.partition(self.hits, -(WORD_TABLE // 2))[-(WORD_TABLE // 2)]) + 1) if len(self.hits) > WORD_TABLE // 2 else 2
        self.hits[0] = np.iinfo(np.int32).max
        kept = np.flatnonzero(self.hits >= least)
        self.words = self.words.take(pa.array(kept))
        self.ids, self.size = self._gather(kept)
        self.first, self.hits = np.cumsum(self.size) - self.size, self.hits[kept] // 2

    def _segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(self.MARK.join(words) + self.MARK, add_special_tokens=False).ids, np.uint32)
        marks = ids == self.MARK_ID
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[row]
        at = np.repeat(self.first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[at], size

    def _append(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
        self.hits = np.append(self.hits, np.zeros(len(words), np.int32))

    def _add(self, words: pa.Array) -> np.ndarray:
        """Rows of words that the table lacked."""
        # A word is its core and the punctuation after it, which the tokenizer parts from a letter or digit before; and an
        # ASCII core is lower-cased by it.  So words share the rows of their parts.
        cores, ends = [], []
        for w in words.to_pylist():
            core = w.rstrip(PUNCTUATION)
            # (lower-casing may leave a mark behind a letter, which the tokenizer joins with the punctuation)
            if not core or len(core) == len(w) or not core[-1].lower()[-1].isalnum() or "<|" in w:
                core = w
            ends.append(w[len(core):])
            cores.append(core.lower() if core.isascii() and "<|" not in core else core)
        cores, ends = pa.array(cores, pa.string()), pa.array(ends, pa.string())
        every = pa.concat_arrays([cores, ends]).unique()
        row = self._rows(every)
        lacking = every.filter(pa.array(row < 0))
        # letters below U+0100 are one piece for the merges: normalising and cutting would leave them as they are
        parts = lacking.to_pylist()
        alone = np.fromiter(("<|" in p or (p.isalpha() and max(p) < "\u0100") for p in parts), bool, len(parts))
        own = [self.tokenizer.encode(p, add_special_tokens=False).ids if "<|" in p else [t.id for t in self.model.tokenize(p.lower().translate(self.bytes))]
               for p, a in zip(parts, alone) if a]
        plain = [p for p, a in zip(parts, alone) if not a]
        found = [self._segment(plain[k:k + 2000]) for k in range(0, len(plain), 2000)]
        ids = np.concatenate([np.fromiter((i for x in own for i in x), np.uint32), *(i for i, _ in found)])
        size = np.concatenate([np.fromiter(map(len, own), np.int64, len(own)), *(n for _, n in found)])
        order = np.argsort(~alone, kind="stable")
        row[np.flatnonzero(row < 0)[order]] = len(self.words) + np.arange(len(order))
        self._append(lacking.take(pa.array(order)), ids, size)
        core, end = (row[pc.index_in(x, value_set=every).to_numpy(zero_copy_only=False)] for x in (cores, ends))
        # a word that is its own core has its row now; the others are put together
        whole = pc.not_equal(words, cores).to_numpy(zero_copy_only=False)
        out = core.copy()
        out[whole] = len(self.words) + np.arange(whole.sum())
        if whole.any():
            ids, size = self._gather(np.stack([core[whole], end[whole]], axis=1).ravel())
            self._append(words.filter(pa.array(whole)), ids, size.reshape(-1, 2).sum(axis=1))
        return out

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words, flat; number of ids of each word)."""
        if len(self.words) > WORD_TABLE:
            self._forget()
        coded = words.dictionary_encode()
        row = self._rows(coded.dictionary)
        new = row < 0
        if new.any():
            row[new] = self._add(coded.dictionary.filter(pa.array(new)))
        self.hits[row] += 1
        return self._gather(row[coded.indices.to_numpy()])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (unless dropped by
    `keep_ids`), ids_crc32, and where it was made (_part, and _rank among the
    pieces of its length there).

    A document's tokens are those of its text (null: none) and then `end_id`;
    only longer ones are cut, into pieces of `capacity` and a rest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        table = per_worker(f"words_{zlib.crc32(tokenizer_json.encode())}", lambda: WordTable(tokenizer_json))
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for run in merged(batches, most=6_000_000):
            words, offsets = words_of(run.column("text"), lower=False)
            ids, size = table.lookup(words)
            upto = np.concatenate([[0], np.cumsum(size)])[offsets]
            at, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for d in range(run.num_rows):
                own = np.append(ids[upto[d]:upto[d + 1]], np.uint32(end_id)).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    one = own[s:s + capacity]
                    at.append(d)
                    piece.append(p)
                    start.append(s)
                    length.append(len(one))
                    crc.append(zlib.crc32(one.tobytes()))
                    rank.append(seen[len(one)])
                    seen[len(one)] += 1
                    if keep_ids:
                        kept.append(one.astype(np.int32))
            cols = [run.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64())]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            cols += [pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "piece", "start", "length", *(["ids"] if keep_ids else []), "ids_crc32", "_part", "_rank"]
    types = [kind, "int", "bigint", "bigint", *(["array<int>"] if keep_ids else []), "bigint", "int", "bigint"]
    return docs.mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def _take(have: np.ndarray, combo: tuple[int, ...]) -> int:
    """How often the lengths of `combo` can be taken together."""
    return min(int(have[x]) // combo.count(x) for x in set(combo))


def exact_fills(have: np.ndarray, first: int, capacity: int):
    """Combinations of `first` and one, two or three further lengths, none
    longer, that fill `capacity` exactly: looked up by their sum among the
    lengths still there (`have` changes while this runs)."""
    gap = capacity - first
    if 1 <= gap <= first and have[gap] > 0:
        yield (first, gap)

    def pairs(total: int, most: int):
        low, high = (total + 1) // 2, min(most, total - 1)
        if low <= high:
            a = np.arange(high, low - 1, -1)
            for x in a[(have[a] > 0) & (have[total - a] > 0)]:
                yield int(x), total - int(x)

    for a, b in pairs(gap, first):
        yield (first, a, b)
    for a in range(min(first, gap - 2), (gap + 2) // 3 - 1, -1):
        if have[a] > 0:
            for b, c in pairs(gap - a, a):
                yield (first, a, b, c)


def packing_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence's pieces, number of such sequences)] that use
    every piece counted in counts[length] once."""
    have = counts.astype(np.int64).copy()
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    if have[capacity]:
        plan[(capacity,)] = int(have[capacity])
        have[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        if have[length]:
            for combo in exact_fills(have, length, capacity):
                if n := _take(have, combo):
                    plan[combo] += n
                    for x in combo:
                        have[x] -= n
                if not have[length]:
                    break
    # best fit of the rest, longest first, alike sequences as one entry
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in range(capacity - 1, 0, -1):
        n = int(have[length])
        while n:
            space = min((s for s, held in room.items() if s >= length and held), default=None)
            if space is None:
                each = min(n, capacity // length)
                room[capacity - each * length][(length,) * each] += n // each
                n -= n // each * each
                continue
            combo, held = room[space].popitem()
            m = min(n, held)
            if held > m:
                room[space][combo] = held - m
            room[space - length][(*combo, length)] += m
            n -= m
    for held in room.values():
        for combo, n in held.items():
            plan[combo] += n
    return list(plan.items())


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length, _part, _rank; as `token_pieces` makes them) with
    sequence_id and offset instead of _part and _rank.

    The driver sees one count per length.  No piece meets another one: ranks
    are made global by a join with one row per task and length.
    """
    pieces = cut_lineage(pieces)
    per_task = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    per_task = cut_lineage(per_task)
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for combo, n in packing_plan(counts, capacity):
        offset = 0
        for x in combo:
            runs.append((x, used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    runs.sort()
    length, rank, base, offset = (np.array(c, np.int64) for c in (zip(*runs) if runs else ([], [], [], [])))
    keys = length * (1 << 48) + rank

    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    names = [c for c in pieces.columns if c not in ("_part", "_rank")]
    schema = ", ".join(f"{n} {t}" for n, t in pieces.select(names).dtypes)

    def put(batches):
        for batch in batches:
            mine, rk = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, mine * (1 << 48) + rk, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(base[at] + rk - rank[at]), pa.array(offset[at])],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(put, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document (doc_id, text) with its place: doc_id,
    piece, start, length, ids, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one token.  Rows that repeat a doc_id
    are packed each; a null doc_id is carried through.  No documents, no
    pieces; other columns are ignored.
    """
    return place_pieces(token_pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids), capacity)
