"""SentencePiece encoding through a table of distinct chunks.

No piece of the model crosses from a word into a following white-space marker
(checked when the model is loaded), so a text's segmentation is that of its
marked words, one after the other.  Each run of texts is cut into marked
words, the distinct ones that the worker's table lacks are segmented once, and
ids are joined back to the texts by position.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import merged, per_worker, whole_texts

#: FIXED VALUE: the library's white-space marker.
MARKER = "▁"

#: Distinct chunks a worker process keeps with their ids before its table starts anew.
CHUNK_TABLE = 300_000

_RUNS = re.compile(" *[^ ]+| +")


class ChunkTable:
    """ids of distinct marked words.  A chunk is kept without the first of its
    markers, which the library adds by itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", n) for n in names):
            raise ValueError("a piece of this model crosses a white-space marker")
        if self.pieces.encode("a  b ") == self.pieces.encode("a b"):
            raise ValueError("this model drops white space; its texts cannot be cut at markers")
        self.lone = self.pieces.piece_to_id(MARKER)
        self.reset()

    def reset(self):
        self.rows: dict[str, int] = {}
        self.size, self.first, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _add(self, chunks: list[str]) -> None:
        found = self.pieces.encode(chunks, num_threads=1)
        found = [i or [self.lone] for i in found]
        for c in chunks:
            self.rows[c] = len(self.rows)
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))])

    def lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the chunks, flat; number of ids of each chunk)."""
        if not len(chunks):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.rows) > CHUNK_TABLE:
            self.reset()
        new = [c for c in distinct if c not in self.rows]
        if new:
            self._add(new)
        row = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self.size[row]
        at = np.repeat(self.first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.ids[at], size


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the texts, flat, each without its first marker, and the
    offsets of each text's chunks.  An empty text has none."""
    texts = pc.replace_substring(texts, MARKER, " ")
    lists = pc.split_pattern(texts, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    runs = np.add.reduceat(np.append(empty, False).astype(np.int64), offsets[:-1]) if len(texts) else np.empty(0)
    if not runs.any():
        return flat, offsets
    # texts with runs of spaces, or with one at an end: a chunk takes the whole run before it
    parts, counts, begin = [], np.diff(offsets), 0
    for d in np.flatnonzero(runs):
        parts.append(flat.slice(offsets[begin], offsets[d] - offsets[begin]))
        text = texts[int(d)].as_py()
        own = [c[1:] for c in _RUNS.findall(" " + text)] if text else []
        parts.append(pa.array(own, pa.string()))
        counts[d], begin = len(own), d + 1
    parts.append(flat.slice(offsets[begin], offsets[-1] - offsets[begin]))
    return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(counts)])


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of `docs`: doc_id and ids, exactly those that
    SentencePieceProcessor.encode gives for the whole text.

    A null text counts as empty and has no ids; a null or repeated doc_id is
    carried through; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        table = per_worker(f"chunks_{zlib.crc32(model)}", lambda: ChunkTable(model))
        for run in merged(batches, most=2_000_000):
            chunks, offsets = marked_words(run.column("text"))
            ids, size = table.lookup(chunks)
            upto = np.concatenate([[0], np.cumsum(size)])[offsets]
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))],
                                             names=["doc_id", "ids"])

    return docs.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """`encoded` (doc_id, ids) plus decoded: what the library's decode makes
    of the ids (null or no ids: the empty text)."""
    with open(model_path, "rb") as f:
        model = f.read()
    encoded = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            texts = [pieces.decode(flat[i:j].tolist()) if j > i else "" for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded string")
