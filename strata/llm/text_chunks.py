"""Texts cut at spaces, and tables of what is made of their distinct chunks.

Two kinds of tokenizer can be run chunk by chunk at such cuts: a byte-level
one whose pieces keep the space before a word, and one whose pieces never
cross from a word into a following white-space marker.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a worker process keeps before it forgets those that one run only held.
CHUNK_TABLE = 400_000

#: Bytes that may follow the space of a cut: none of them begins a white-space character.
_FOLLOW = np.zeros(256, bool)
_FOLLOW[0x21:0x7F] = True       # ASCII without controls
_FOLLOW[0xC3:0xE0] = True       # U+00C0 to U+07FF
_FOLLOW[0xE3:0xEE] = True       # U+3000 to U+DFFF, less the ideographic space's row
_FOLLOW[0xF0:0xF5] = True       # U+10000 and beyond


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of the texts, flat, and the offsets of each text's chunks
    (one more than texts).  A text is cut before every space that follows
    something else than a space and precedes no white space; chunks share the
    texts' bytes, and an empty text has none."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    body = data[at[0]:at[-1]]
    spaces = np.flatnonzero(body[1:-1] == 0x20) + 1 if len(body) > 2 else np.empty(0, np.int64)
    follow = body[spaces + 1]
    cut = (body[spaces - 1] != 0x20) & _FOLLOW[follow]
    row_of_3000 = np.flatnonzero(cut & (follow == 0xE3))
    second = np.minimum(spaces[row_of_3000] + 2, len(body) - 1)
    cut[row_of_3000] = body[second] != 0x80
    spaces = spaces[cut] + at[0]
    mark = np.zeros(at[-1] + 1, bool)
    mark[at] = True
    mark[spaces[~mark[spaces + 1]]] = True
    bounds = np.flatnonzero(mark).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), texts.buffers()[2] if len(data) else pa.py_buffer(b""))
    return chunks, np.searchsorted(bounds, at)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class ChunkTable:
    """What `make` gives for distinct chunks: named flat arrays with a number
    of entries per chunk.  Row numbers hold until the next `rows`; beyond
    CHUNK_TABLE chunks, those that a single run held are forgotten."""

    def __init__(self, make):
        self.make = make
        self.known = pa.array([], pa.string())
        self.hits = np.empty(0, np.int32)   # runs that held the chunk
        self.flat: dict[str, np.ndarray | pa.Array] = {}
        self.size: dict[str, np.ndarray] = {}
        self.first: dict[str, np.ndarray] = {}

    def rows(self, chunks: pa.Array) -> np.ndarray:
        """The row of each chunk."""
        if len(self.known) > CHUNK_TABLE:
            self._forget()
        coded = chunks.dictionary_encode()
        row = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = row < 0
        if new.any() or not self.flat:
            row[new] = len(self.known) + np.arange(new.sum())
            names = coded.dictionary.filter(pa.array(new))
            self._add(names, self.make(names.to_pylist()))
        self.hits[row] += 1
        return row[coded.indices.to_numpy()]

    def _add(self, names: pa.Array, made: dict) -> None:
        self.known = pa.concat_arrays([self.known, names])
        self.hits = np.append(self.hits, np.zeros(len(names), np.int32))
        for name, (flat, size) in made.items():
            if name in self.flat:
                size = np.concatenate([self.size[name], size])
                flat = pa.concat_arrays([self.flat[name], flat]) if isinstance(flat, pa.Array) else np.concatenate([self.flat[name], flat])
            self._put(name, flat, size)

    def _put(self, name: str, flat, size: np.ndarray) -> None:
        self.flat[name], self.size[name], self.first[name] = flat, size, np.cumsum(size) - size

    def take(self, name: str, rows: np.ndarray):
        """(entries of the rows, flat; number of entries of each row)."""
        size = self.size[name][rows]
        at = ragged(self.first[name][rows], size)
        flat = self.flat[name]
        return (flat.take(pa.array(at)) if isinstance(flat, pa.Array) else flat[at]), size

    def _forget(self) -> None:
        half = CHUNK_TABLE // 2
        least = max(2, int(np.partition(self.hits, -half)[-half]) + 1) if len(self.hits) > half else 2
        kept = np.flatnonzero(self.hits >= least)
        for name in self.flat:
            self._put(name, *self.take(name, kept))
        self.known = self.known.take(pa.array(kept))
        self.hits = self.hits[kept] // 2


class ByteLevel:
    """A byte-level tokenizer run over many chunks at once."""

    #: Bytes of chunks that are encoded as one string.
    RUN = 20_000

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel as Step

        self.whole = Tokenizer.from_str(tokenizer_json)      # special tokens' strings become their ids
        self.plain = Tokenizer.from_str(tokenizer_json)      # they are text like any other
        self.plain.encode_special_tokens = True
        step = json.loads(tokenizer_json)
        self.special = [t["content"] for t in step["added_tokens"]]
        pre = step["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or step["normalizer"] or step["post_processor"]:
            raise ValueError("chunks are encoded by themselves only for a byte-level tokenizer without normaliser, prefix space and post-processor")
        # an id's token has one letter per byte
        letters = {c: b for b in range(256) for c in [_letter(b)]}
        if set(letters) != set(Step.alphabet()):
            raise ValueError("this tokenizer's letters for bytes are not the usual ones")
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * self.whole.get_vocab_size()
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.bytes[i] = bytes(map(letters.__getitem__, token))
        self.length = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the chunks, flat; number of ids of each), special
        tokens' strings as text.  Chunks that begin as `chunks_of` cuts are
        strung together: the tokenizer cuts them there by itself."""
        runs, run, used = [], [], 0
        for c in chunks:
            follows = len(c) > 1 and c[0] == " " and c[1] != "　" and _FOLLOW[c[1].encode()[0]]
            if run and (used > self.RUN or not follows):
                runs.append("".join(run))
                run, used = [], 0
            run.append(c)
            used += len(c)
        if run:
            runs.append("".join(run))
        ids = [np.empty(0, np.int32)]
        for k in range(0, len(runs), 8):
            ids += [np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(runs[k:k + 8], add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        upto = np.searchsorted(np.cumsum(self.length[ids]), ends, side="right")
        return ids, np.diff(upto, prepend=0)


def _letter(b: int) -> str:
    """The letter of a byte in a byte-level vocabulary: itself where it is
    printable, else the next free one from U+0100 on."""
    shown = lambda x: 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x <= 0xFF
    return chr(b) if shown(b) else chr(0x100 + sum(not shown(x) for x in range(b)))
