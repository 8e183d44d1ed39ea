"""Quality classifier on learned vectors of hashed words and character n-grams.

A document is the mean of the vectors of its features (words, character
n-grams, and whether a word repeats the one before); a softmax over the two
classes follows.  Vectors and output weights are trained by numpy stochastic
gradient descent on a bounded sample of labelled documents.  As nothing
non-linear stands between a feature's vector and the output, scoring a whole
text needs one number per feature: its vector times the difference of the
output weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import slices, small_batches, whole_texts, words_of

#: Hash buckets of words and of character n-grams, and the vectors' length.
BUCKETS_LOG2 = 18
DIMENSIONS = 8
NGRAMS = (3, 4)
#: Labelled documents of each class that training takes at most.
SAMPLE_PER_CLASS = 2500
#: Bytes of text of one numpy run; its arrays take about 50 times as much.
RUN_BYTES = 1_000_000
#: Score from which a document counts as good.
THRESHOLD = 0.3

_ODD = np.uint32(2654435761)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return ((h * _ODD) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int32)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """32-bit hash of each word: a polynomial over its bytes."""
    coded = words.dictionary_encode()
    words = coded.dictionary
    at = words.offsets if hasattr(words, "offsets") else np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    at = np.asarray(at, np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0]:at[-1]] if len(words) else np.empty(0, np.uint8)
    at = at - at[0]
    size = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1], size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 16777619, np.uint32), dtype=np.uint32)
    terms = (raw.astype(np.uint32) + np.uint32(1)) * powers[place]
    total = np.zeros(len(words), np.uint32)
    if len(raw):
        total = np.add.reduceat(terms, at[:-1], dtype=np.uint32)
    return total[coded.indices.to_numpy()]


def features(texts: pa.Array):
    """Arrays of (bucket of every feature occurrence, text of each): words and
    repeats first, then one array pair per n-gram length.  Buckets of words,
    repeats and n-grams share one table."""
    words, offsets = words_of(texts, lower=False)
    if len(words):
        h = _word_hashes(words)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
        yield _bucket(h), doc
        inside = doc[1:] == doc[:-1]
        yield _bucket(np.where(h[1:] == h[:-1], np.uint32(77), np.uint32(78)))[inside], doc[1:][inside]
    # an end mark closes every text, and belongs to it
    points = np.frombuffer("".join(t + "\0" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    for n in NGRAMS:
        if len(points) < n:
            continue
        h = points[:len(points) - n + 1] * np.uint32(2246822519) + np.uint32(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917) + points[k:len(points) - n + 1 + k]
        inside = doc[:len(h)] == doc[n - 1:n - 1 + len(h)]
        yield _bucket(h)[inside], doc[:len(h)][inside]


def _compact(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its features."""
    bucket, doc = (np.concatenate(x) for x in zip((np.empty(0, np.int32), np.empty(0, np.int32)), *features(texts)))
    key, count = np.unique(doc.astype(np.int64) << 32 | bucket, return_counts=True)
    cuts = np.searchsorted(key >> 32, np.arange(len(texts) + 1))
    out = []
    for d in range(len(texts)):
        c = count[cuts[d]:cuts[d + 1]]
        out.append(((key[cuts[d]:cuts[d + 1]] & 0xFFFFFFFF).astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    return out


def train(sample: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 20.0, seed: int = 7):
    """(vectors, output weights, bias) fitted by stochastic gradient descent,
    a document at a time, with a falling rate; deterministic."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(sample))
    for _ in range(epochs):
        for d in rng.permutation(len(sample)):
            lr = rate * (1 - step / steps)
            step += 1
            bucket, share = sample[d]
            mean = share @ vectors[bucket]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[d]] -= 1
            back = out @ p
            out -= np.float32(lr * 0.05) * np.outer(mean, p)
            bias -= np.float32(lr * 0.01) * p
            vectors[bucket] -= np.float32(lr) * share[:, None] * back
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """(weight of every bucket, bias) of the log odds of class 1.

    Learns only from labelled documents with crc32(doc_id as text) mod 5 not
    0, of them at most `per_class` of each class, those that come first by a
    hash of doc_id.  A doc_id with labels of both classes is not learnt from;
    of rows that repeat a doc_id, the one whose text has the smallest hash is.
    One task trains on this bounded sample, and only the weights reach the
    driver.  Without both classes the weights are 0 and the bias is 8 (only
    class 1 seen), -8 (only class 0) or 0 (no labels).
    """
    usable = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id is not null and label in (0, 1)") \
        .filter("crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")) \
        .filter("label = _most").drop("_most")
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_class ids: a proven bound
    picked = whole_texts(docs).join(F.broadcast(chosen), "doc_id")

    def shares(batches):
        for batch in batches:
            for run in slices(batch, most=RUN_BYTES):
                found = _compact(run.column("text"))
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("label"), run.column("_h"), pa.array([b.tobytes() for b, _ in found], pa.binary()),
                                                  pa.array([s.tobytes() for _, s in found], pa.binary())], names=["doc_id", "label", "_h", "bucket", "share"])

    def learn(batches):
        rows = {}
        for batch in batches:
            for i, label, h, bucket, share in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in rows or h < rows[i][0]:
                    rows[i] = (h, label, bucket, share)
        y = np.array([rows[i][1] for i in sorted(rows)], np.int64)
        weights, bias = np.zeros(1 << BUCKETS_LOG2, np.float32), float(len(y) and (8.0 if y[0] else -8.0))
        if len(set(y.tolist())) == 2:
            vectors, out, biases = train([(np.frombuffer(rows[i][2], np.int32), np.frombuffer(rows[i][3], np.float32)) for i in sorted(rows)], y)
            weights, bias = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(biases[1] - biases[0])
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    kind = picked.schema["doc_id"].dataType.simpleString()
    sample = picked.select("doc_id", "text", F.col("label").cast("int"), F.xxhash64("text").alias("_h")).mapInArrow(
        shares, f"doc_id {kind}, label int, _h long, bucket binary, share binary")
    got = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return np.frombuffer(got["weights"], np.float32), got["bias"]


def with_score(docs: DataFrame, weights: np.ndarray, bias: float, name: str = "score") -> DataFrame:
    """`docs`, all columns, plus the score of the whole text (null: empty)."""
    small_batches(docs.sparkSession)
    weights = weights.astype(np.float32)

    def score(batches):
        for batch in batches:
            for run in slices(batch, most=RUN_BYTES):
                texts = pc.fill_null(run.column("text"), "")
                total, count = np.zeros(run.num_rows), np.zeros(run.num_rows)
                for bucket, doc in features(texts):
                    total += np.bincount(doc, weights[bucket], run.num_rows)
                    count += np.bincount(doc, minlength=run.num_rows)
                odds = total / np.maximum(count, 1) + bias
                p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(p)], names=[*run.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    The score reads the whole text and nothing else; a null text counts as
    empty and gets the score of the bias.  held_out: crc32(doc_id as text)
    mod 5 is 0 (a null doc_id is held out).  Repeated rows are scored each.
    """
    scored = with_score(whole_texts(docs), weights, bias)
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, true)").alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that a classifier fitted on
    `labels` (doc_id, quality) does not reject."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, *fit(docs, labels, per_class), name).filter(F.col(name) >= threshold).drop(name)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """`score_quality` by a classifier fitted on `labels` (doc_id, quality)."""
    return score_quality(docs, *fit(docs, labels, per_class), threshold)
