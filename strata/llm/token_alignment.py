"""Alignment of two tokenizers by interval coalescing, and how often token pairs
go together.

A is a byte-level tokenizer run on a space and the text, B a SentencePiece
model run on the text, which adds that space.  All tokens of both, as byte
intervals, are sorted by start; the running maximum of their ends closes a
group wherever a start reaches it, and overlaps are expanded inside groups.
Groups never cross a cut of `chunks_of`, so each distinct chunk is aligned once
per worker.

Counts of linked id pairs are exchanged by runs of documents: a run sends each
of its pairs once, with the number of its documents that hold it, and gets
each pair's count in the corpus back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import merged, per_worker, whole_texts
from strata.llm.simple8b import pack, unpack
from strata.llm.text_chunks import ByteLevel, ChunkTable, chunks_of, ragged
from strata.session import cut_lineage

#: FIXED VALUE: the library's white-space marker.
MARKER = "▁"

#: Bytes of text in a run of documents, and pairs that are expanded at once.
RUN_BYTES = 4_000_000
PAIRS_AT_ONCE = 2_000_000


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the intervals, group of each in that order): sorted by start,
    a group ends where the next start reaches all ends so far."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate([[False], start[order][1:] >= reach[:-1]]) if len(order) else np.empty(0, bool)
    return order, np.cumsum(breaks)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of their times)."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def joined_lists(values: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    """The strings between consecutive offsets, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), by)


class Aligner:
    """Both tokenizers, and the alignment of chunks that begin with a space."""

    def __init__(self, tokenizer_json: str, model: bytes):
        import sentencepiece

        self.a = ByteLevel(tokenizer_json)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", n) for n in names):
            raise ValueError("a piece of this model crosses a white-space marker")
        if self.b.encode("a  b ") == self.b.encode("a b"):
            raise ValueError("this model drops white space; its texts cannot be cut at spaces")
        held = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(MARKER, " ").encode() for i, n in enumerate(names)]
        self.b_bytes = np.frombuffer(b"".join(held), np.uint8)
        self.b_length = np.fromiter(map(len, held), np.int64, len(held))
        self.b_first = np.cumsum(self.b_length) - self.b_length
        self.numbers = pa.array([str(i) for i in range(max(len(self.a.length), len(held)))])

    @property
    def many_b(self) -> int:
        return len(self.b_length)

    @property
    def many_pairs(self) -> int:
        return len(self.a.length) * self.many_b

    def align(self, chunks: list[str]) -> dict:
        """Per chunk: ok (1 if both tokenizers keep its bytes), n_a, n_b,
        n_groups, n_links, text of its groups, and its distinct linked pairs
        (a * many_b + b) with how many links each has.  A chunk that is not ok
        has no tokens."""
        n = len(chunks)
        raw = [c.encode() for c in chunks]
        length = np.fromiter(map(len, raw), np.int64, n)
        a, size_a = self.a.encode(chunks)
        found = self.b.encode([c[1:] for c in chunks], num_threads=1)
        size_b = np.fromiter(map(len, found), np.int64, n)
        b = np.fromiter((i for x in found for i in x), np.int64, int(size_b.sum()))
        ok = self._same_bytes(raw, length, b, size_b)
        a, b = a[np.repeat(ok, size_a)], b[np.repeat(ok, size_b)]
        size_a, size_b = np.where(ok, size_a, 0), np.where(ok, size_b, 0)

        # chunks that are ok, end to end on one axis of bytes
        ids = np.concatenate([a, b]).astype(np.int64)
        side = np.repeat([0, 1], [len(a), len(b)])
        end = np.concatenate([np.cumsum(self.a.length[a]), np.cumsum(self.b_length[b])])
        start = end - np.concatenate([self.a.length[a], self.b_length[b]])
        chunk = np.concatenate([np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)])
        order, group = coalesce(start, end, side)
        many = int(group[-1]) + 1 if len(group) else 0
        ids, side, chunk = ids[order], side[order], chunk[order]
        of_a, of_b = side == 0, side == 1
        in_a, in_b = np.bincount(group[of_a], minlength=many), np.bincount(group[of_b], minlength=many)
        owner = np.zeros(many, np.int64)
        owner[group] = chunk
        n_groups = np.bincount(owner, minlength=n)
        links = np.bincount(owner, in_a * in_b, n).astype(np.int64)

        texts = [joined_lists(self.numbers.take(pa.array(ids[m])), np.concatenate([[0], np.cumsum(k)]), ",") for m, k in ((of_a, in_a), (of_b, in_b))]
        text = joined_lists(pc.binary_join_element_wise(*texts, "|"), np.concatenate([[0], np.cumsum(n_groups)]), ";")
        keys, times = self._pairs(ids, side, group, owner, many)
        held = np.bincount(keys // self.many_pairs, minlength=n)
        one = np.ones(n, np.int64)
        return {"ok": (ok.astype(np.int64), one), "n_a": (size_a, one), "n_b": (size_b, one), "n_groups": (n_groups, one), "n_links": (links, one),
                "text": (text, one), "pairs": (keys % self.many_pairs, held), "times": (times, held)}

    def _same_bytes(self, raw: list[bytes], length: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether the pieces of each chunk spell it."""
        spelt = np.add.reduceat(np.append(self.b_length[b], 0), np.minimum(np.cumsum(size_b) - size_b, len(b))) * (size_b > 0) if len(raw) else length
        ok = spelt == length
        mine = np.frombuffer(b"".join(r for r, o in zip(raw, ok.tolist()) if o), np.uint8)
        own = b[np.repeat(ok, size_b)]
        wrong = np.flatnonzero(self.b_bytes[ragged(self.b_first[own], self.b_length[own])] != mine)
        at = np.flatnonzero(ok)
        ok[at[np.searchsorted(np.cumsum(length[at]), wrong, side="right")]] = False
        return ok

    def _pairs(self, ids: np.ndarray, side: np.ndarray, group: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (chunk, a, b) as one number, in order, and their links.
        Ids that a group repeats are counted before pairs are made, and pairs
        are made a slice at a time."""
        width = max(len(self.a.length), self.many_b)
        (key_a, times_a), (key_b, times_b) = (summed(group[side == s] * width + ids[side == s], np.ones(int((side == s).sum()), np.int64)) for s in (0, 1))
        group_a, group_b = key_a // width, key_b // width
        size = np.bincount(group_b, minlength=many)
        first = np.cumsum(size) - size
        per_a = size[group_a]
        out_keys, out_times, begin, upto = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, np.cumsum(per_a)
        while begin < len(key_a):
            done = upto[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, side="right")))
            g, k = group_a[begin:stop], per_a[begin:stop]
            other = ragged(first[g], k)
            pair = np.repeat(owner[g] * self.many_pairs + key_a[begin:stop] % width * self.many_b, k) + key_b[other] % width
            keys, times = summed(pair, np.repeat(times_a[begin:stop], k) * times_b[other])
            out_keys.append(keys)
            out_times.append(times)
            begin = stop
        return summed(np.concatenate(out_keys), np.concatenate(out_times))


def aligned_tokens(docs: DataFrame, tokenizer_path: str, model_path: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups,
    n_links (pairs of token occurrences in one group) and groups, which reads
    a1,a2|b1;a3|b2,b3: the decimal ids of A and of B, group by group.

    A text that is null or empty, or that either tokenizer does not spell byte
    by byte with a space before it, has no tokens: zeros and ''.  Special
    tokens' strings are text like any other.  Rows that share a doc_id, or
    have none, are aligned each; other columns are ignored.

    Columns _run, _nth, _pairs, _docs, _at, _times and _sizes are for
    `link_counts`: the first row of each run of documents holds the run's
    linked id pairs, how many of its documents hold each, and, packed, each
    document's pairs by their place among the run's, with their links.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    with open(model_path, "rb") as f:
        model = f.read()
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = "aligner_" + hashlib.sha1(tokenizer_json.encode() + model).hexdigest()

    def build():
        aligner = Aligner(tokenizer_json, model)
        return aligner, ChunkTable(aligner.align)

    def align(batches):
        aligner, table = per_worker(made, build)
        run_id = TaskContext.get().partitionId() << 33
        for run in merged(batches, most=RUN_BYTES):
            yield _aligned_run(aligner, table, run, run_id, names)
            run_id += 1

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_run", "_nth", "_pairs", "_docs", "_at", "_times", "_sizes"]
    kinds = [kind, "long", "long", "long", "long", "string", "long", "long", "array<long>", "array<int>", "binary", "binary", "binary"]
    return docs.mapInArrow(align, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))


def _aligned_run(aligner: Aligner, table: ChunkTable, run: pa.RecordBatch, run_id: int, names: list[str]) -> pa.RecordBatch:
    """Alignment and packed pairs of a run of documents."""
    texts, n = run.column("text"), run.num_rows
    out = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring(texts, MARKER))
    spaced = pc.if_else(out, "", pc.binary_join_element_wise("", texts, " "))
    chunks, offsets = chunks_of(spaced)
    rows = table.rows(chunks)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    # a chunk that does not keep its bytes takes its document's tokens away
    bad = np.zeros(n, bool)
    if len(rows):
        bad[doc[table.flat["ok"][rows] == 0]] = True
        keep = ~bad[doc]
        rows, doc = rows[keep], doc[keep]
    count = np.bincount(doc, minlength=n)
    sums = {}
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        sums[name] = np.bincount(doc, table.flat[name][rows], n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
    text = table.take("text", rows)[0] if len(rows) else pa.array([], pa.string())
    groups = joined_lists(text, np.concatenate([[0], np.cumsum(count)]), ";")
    # links of each document: of its distinct chunks, then of their distinct pairs
    if len(rows):
        many = len(table.known)
        key, times = summed(doc * many + rows, np.ones(len(rows), np.int64))
        pairs, size = table.take("pairs", key % many)
        links = table.take("times", key % many)[0] * np.repeat(times, size)
        key, links = summed(np.repeat(key // many, size) * aligner.many_pairs + pairs, links)
        of_doc = key // aligner.many_pairs
        distinct, place = np.unique(key % aligner.many_pairs, return_inverse=True)
        held = np.bincount(place, minlength=len(distinct))
        # a document's places ascend: differences are small
        step = np.diff(place, prepend=0)
        begins = np.flatnonzero(np.diff(of_doc, prepend=-1))
        step[begins] = place[begins]
        sizes = np.bincount(of_doc, minlength=n)
    else:
        distinct = held = step = links = np.empty(0, np.int64)
        sizes = np.zeros(n, np.int64)
    only_first = lambda value, kind: pa.array([value] + [None] * (n - 1), kind)
    cols = [run.column("doc_id"), *(pa.array(sums[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), groups, pa.array(np.full(n, run_id)), pa.array(np.arange(n)),
            only_first(distinct, pa.list_(pa.int64())), only_first(held.astype(np.int32), pa.list_(pa.int32())),
            *(only_first(_packed(x), pa.binary()) for x in (step, links, sizes))]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _packed(values: np.ndarray) -> bytes:
    words, first, escapes = pack(values)
    return b"".join([np.array([len(values), len(first), len(words)], "<u8").tobytes(), first.astype("<u8").tobytes(), words.tobytes(), escapes.tobytes()])


def _unpacked(content: bytes) -> np.ndarray:
    held = np.frombuffer(content, "<u8")
    n, blocks, words = map(int, held[:3])
    return unpack(held[3 + blocks:3 + blocks + words], held[3:3 + blocks].astype(np.int64), held[3 + blocks + words:], n).astype(np.int64)


def link_counts(aligned: DataFrame, tokenizer_path: str, model_path: str) -> DataFrame:
    """`aligned` (from `aligned_tokens`, all its rows; columns without _ may be
    changed or dropped) with n_best and count_sum instead of its columns with
    _.  An id pair's count is the number of rows of `aligned` that hold it
    linked; count_sum adds the counts of a row's links, and n_best counts the
    links whose count is the highest that their A id has with any B id (ties
    included).  Rows without links have zeros.

    The rows are written once; then each run of documents sends its distinct
    pairs, so that what is shuffled is smaller than links by the repetition
    inside runs.  No group holds more than a run."""
    import sentencepiece

    many_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    own = [c for c in aligned.columns if not c.startswith("_")]
    aligned = cut_lineage(aligned)
    asked = aligned.where("_pairs IS NOT NULL").select(F.col("_run").alias("_owner"), F.posexplode(F.arrays_zip("_pairs", "_docs")).alias("_place", "_p"))
    asked = asked.select("_owner", "_place", F.col("_p._pairs").alias("_pair"), F.col("_p._docs").alias("_n"))
    counts = cut_lineage(asked.groupBy("_pair").agg(F.sum("_n").alias("_count")))
    a = F.floor(F.col("_pair") / many_b).cast("int")
    top = counts.groupBy(a.alias("_a")).agg(F.max("_count").alias("_top"))     # at most one row per id of A
    counts = counts.withColumn("_a", a).join(F.broadcast(top), "_a").select("_pair", "_count", (F.col("_count") == F.col("_top")).alias("_best"))
    answers = asked.drop("_n").join(counts, "_pair").select("_owner", "_place", "_count", "_best")

    held = ["_at", "_times", "_sizes"]
    rows = aligned.select(*own, "_run", "_nth", *held)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(own).dtypes) + ", n_best long, count_sum long"

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("_nth")
        step, links, sizes = (_unpacked(docs.column(c)[0].as_py()) for c in held)
        count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, bool)
        at = answers.column("_place").to_numpy()
        count[at], best[at] = answers.column("_count").to_numpy(), answers.column("_best").to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        # places are running sums of the steps inside each document
        run = np.cumsum(step)
        before = np.concatenate([[0], run])[upto[:-1]]
        place = run - np.repeat(before, sizes)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
        out = docs.select(own)
        return out.append_column("n_best", pa.array(total(links * best[place]))).append_column("count_sum", pa.array(total(links * count[place])))

    return rows.groupBy("_run").cogroup(answers.groupBy("_owner")).applyInArrow(score, schema)
