"""Fill-in-the-middle with cuts found through a learned rank index.

Cuts are drawn in code points, texts are stored in bytes.  For each run of
texts the byte offsets of all code points are fitted by lines whose error is
bounded; what a line misses is kept as one signed byte per boundary.  A cut is
predicted by its line and corrected by that byte, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import merged, whole_texts
from strata.llm.text_chunks import ragged

#: FIXED VALUES: what marks the prefix, the suffix and the middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Largest error of a line, so that a residual is one signed byte.
MOST_ERROR = 127

#: Boundaries that are fitted at once; a line covers no more.
AT_ONCE = 1 << 20


class RankIndex:
    """Offsets of all boundaries as lines and residuals.

    `starts` are ranks at which lines begin for certain (those of the texts);
    a line that errs by more than `most` is halved until none does.  Lines are
    fitted over some AT_ONCE boundaries at a time."""

    def __init__(self, offsets: np.ndarray, starts: np.ndarray, most: int = MOST_ERROR):
        self.residual = np.zeros(len(offsets), np.int8)
        begin = np.unique(np.concatenate([starts, np.arange(0, len(offsets), AT_ONCE)]))
        begin = begin[begin < len(offsets)]
        later_lo, later_hi = begin, np.append(begin[1:], len(offsets))
        first, base, slope = [], [], []
        while len(later_lo):
            now = max(1, int(np.searchsorted(np.cumsum(later_hi - later_lo), AT_ONCE, side="right")))
            lo, hi = later_lo[:now], later_hi[:now]
            size = hi - lo
            rise = (offsets[hi - 1] - offsets[lo]) / np.maximum(size - 1, 1)
            at = ragged(lo, size)
            left = offsets[at] - _on_line(np.repeat(offsets[lo].astype(np.int64), size), np.repeat(rise, size), at - np.repeat(lo, size))
            fits = np.maximum.reduceat(np.abs(left), np.cumsum(size) - size) <= most
            held = np.repeat(fits, size)
            self.residual[at[held]] = left[held]
            first.append(lo[fits])
            base.append(offsets[lo[fits]].astype(np.int64))
            slope.append(rise[fits])
            lo, hi = lo[~fits], hi[~fits]
            middle = (lo + hi) // 2
            later_lo, later_hi = np.concatenate([lo, middle, later_lo[now:]]), np.concatenate([middle, hi, later_hi[now:]])
        first = np.concatenate(first) if first else np.empty(0, np.int64)
        order = np.argsort(first)
        self.first = first[order]
        self.base = np.concatenate(base)[order] if base else first
        self.slope = np.concatenate(slope)[order] if slope else first.astype(float)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of the boundaries with these ranks."""
        line = np.searchsorted(self.first, ranks, side="right") - 1
        return _on_line(self.base[line], self.slope[line], ranks - self.first[line]) + self.residual[ranks]


def _on_line(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * steps).astype(np.int64)


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts, offset of every code point and of the end, rank of
    each text's first boundary and of the end) of an array of strings."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    body = np.frombuffer(held, np.uint8)[at[0]:at[-1]] if held is not None else np.empty(0, np.uint8)
    offsets = np.append(np.flatnonzero((body & 0xC0) != 0x80).astype(np.int32), np.int32(len(body)))
    return body, offsets, np.searchsorted(offsets, at - at[0])


def draws(doc_id: Column, seed: int, many: int = 4) -> list[Column]:
    """`many` unsigned 32-bit numbers of a document: the leading 8-digit
    groups of the hex sha256 of seed:doc_id (a null doc_id: of seed:)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(many)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, most_error: int = MOST_ERROR) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n (code points of the
    whole text), form, prefix_chars, middle_chars (code points; null if plain)
    and output.

    Two numbers drawn from the doc_id cut the text into prefix, middle and
    suffix.  form is psm (prefix, suffix, middle), in `spm_percent` of 100
    cases spm (suffix, prefix, middle), and plain, which is the text itself,
    in `plain_percent` of 100 cases and wherever the text is null, empty or
    holds one of the marks.  Rows that share a doc_id share its draws; a null
    doc_id has draws of its own.  Other columns are ignored.
    """
    docs = whole_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = docs.select("doc_id", "text", *[c.alias(f"_h{i}") for i, c in enumerate(draws(F.col("doc_id"), seed))])

    def cut(batches):
        for run in merged(batches, most=2_000_000):
            texts = run.column("text")
            body, offsets, starts = boundaries(texts)
            n = np.diff(starts)
            h = [run.column(f"_h{i}").to_numpy() for i in range(4)]
            a, b = h[0] % (n + 1), h[1] % (n + 1)
            index = RankIndex(offsets, starts[:-1], most_error)
            low, high = np.minimum(a, b), np.maximum(a, b)
            edges = np.stack([index.locate(starts[:-1] + x) for x in (0, low, high, n)], axis=1)
            plain = (n == 0) | (h[2] % 100 >= 100 - plain_percent)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            spm = h[3] % 100 < spm_percent
            raw, out = body.tobytes(), []
            for (i, j, k, m), p, s in zip(edges.tolist(), plain.tolist(), spm.tolist()):
                if p:
                    out.append(raw[i:m])
                else:
                    prefix, suffix = PREFIX.encode() + raw[i:j], SUFFIX.encode() + raw[k:m]
                    out.append(b"".join((*((suffix, prefix) if s else (prefix, suffix)), MIDDLE.encode(), raw[j:k])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain),
                                              pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return drawn.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output of `fill_in_middle` was made from.  A mark
    cannot arise where parts meet, so the marks found are those put there."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
