"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class, given the two tokens before it,
times that of the token within its class.  The class softmax has hashed
features: the token before (bigram), the token before that (skip), and both
(trigram), each a class-sized weight vector.  Its sufficient statistics, how
often each class follows each pair of context classes, are counted over all
training tokens; the weights are then trained by gradient updates whose sums
over contexts Spark's tasks compute.  Within a class only bias features are
used, whose maximum-entropy solution is the relative frequency.

Scoring looks up class probabilities in numpy, batch by batch.  The most
frequent words come with the task; the counts of all others, as many as the
corpus has, are joined by word.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import merged, whole_texts, words_of
from strata.session import cut_lineage

#: FIXED VALUE: added to every count.
ALPHA = 0.1

#: Words that come with every task, and bytes of a word there (at most HEAD * HEAD_BYTES bytes are broadcast).
HEAD, HEAD_BYTES = 1 << 16, 48
#: Frequent words that are a class of their own, and classes by the ending of all others (each once with and once without
#: closing punctuation), of which the last RARE are hashed.
SINGLES, HASHED, RARE = 47, 48, 8
CLASSES = 1 + SINGLES + 2 * HASHED
END, BEGIN = 0, CLASSES
CONTEXTS = CLASSES + 1
TRIGRAMS_LOG2 = 13
#: Rate of the gradient updates.  They end when PATIENCE of them in a row together lower the loss (nats a token) by less than TOLERANCE.
RATE, PATIENCE, TOLERANCE = 0.3, 5, 1e-3


def _ending(word: str) -> tuple[str, bool]:
    """The last two characters before closing punctuation, and whether there is any."""
    core = word.rstrip(".,;:!?%*#$&|\"')]}")
    return core[-2:], len(core) < len(word)


def frequent_endings(words: list[str], c: np.ndarray) -> dict[str, int]:
    """The most frequent endings of the head words, numbered; all others share
    the last RARE hashed classes."""
    total: dict[str, float] = {}
    for w, n in zip(words, c):
        e = _ending(w)[0]
        total[e] = total.get(e, 0) + float(n)
    return {e: k for k, e in enumerate(sorted(total, key=lambda e: (-total[e], e))[:HASHED - RARE])}


def surface_class(words: list[str], endings: dict[str, int]) -> np.ndarray:
    """Class of words without a class of their own: by their ending, and
    whether punctuation closes them."""
    out = np.empty(len(words), np.int64)
    for k, w in enumerate(words):
        e, closed = _ending(w)
        own = endings.get(e)
        if own is None:
            own = HASHED - RARE + zlib.crc32(e.encode()) % RARE
        out[k] = 1 + SINGLES + own + (HASHED if closed else 0)
    return out


def _trigram(context: np.ndarray) -> np.ndarray:
    """Hashed feature of a context number (class before last, class last)."""
    return ((context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TRIGRAMS_LOG2)).astype(np.int64)


def log_softmax(weights: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    """Natural-log class probabilities of each context."""
    z = weights["bias"] + weights["bigram"][context % CONTEXTS] + weights["skip"][context // CONTEXTS] + weights["trigram"][_trigram(context)]
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Lexicon:
    """Classes of words: `rows` has those of the head words, others are found
    from their spelling once per batch."""

    def __init__(self, head: pa.Array, classes: np.ndarray, endings: dict[str, int]):
        self.head, self.classes, self.endings = head, classes, endings

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(head row or -1, class) of every word."""
        coded = words.dictionary_encode()
        row = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cls = np.where(row >= 0, self.classes[np.maximum(row, 0)] if len(self.classes) else 0, 0)
        rare = np.flatnonzero(row < 0)
        cls[rare] = surface_class(coded.dictionary.take(pa.array(rare)).to_pylist(), self.endings)
        at = coded.indices.to_numpy()
        return row[at], cls[at]


def _contexts(cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, context number, text) of every token, the ends included."""
    n = np.diff(offsets) + 1
    ends = np.cumsum(n) - 1
    tokens = np.full(int(n.sum()), END, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = cls
    first = ends - n + 1
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[first] = BEGIN
    two[first] = BEGIN
    two[np.minimum(first + 1, ends)] = BEGIN
    return tokens, two * CONTEXTS + one, np.repeat(np.arange(len(n)), n)


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all training texts."""
    def count(batches):
        for run in merged(batches, most=12_000_000):
            words, _ = words_of(run.column("text"))
            v = words.value_counts()
            yield pa.RecordBatch.from_arrays([v.field("values"), v.field("counts")], names=["word", "c"])

    return train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def context_counts(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    """How often each class follows each context: context, class, n."""
    def count(batches):
        total = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int32)
        for run in merged(batches):
            words, offsets = words_of(run.column("text"))
            tokens, context, _ = _contexts(lexicon.of(words)[1], offsets)
            total += np.bincount(context * CLASSES + tokens, minlength=len(total)).astype(np.int32)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            some = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some // CLASSES, pa.int32()), pa.array(some % CLASSES, pa.int32()), pa.array(total[some], pa.int64())],
                                             names=["context", "class", "n"])

    counted = train.select("text").mapInArrow(count, "context int, class int, n long")
    return counted.groupBy("context", "class").agg(F.sum("n").alias("n"))


def train_classes(counts: DataFrame, rate: float = RATE, tolerance: float = TOLERANCE) -> dict[str, np.ndarray]:
    """Weights of the class softmax, from `context_counts`, trained until the
    loss falls no more; those with the least loss are returned.

    Each update's gradient is the sum, over the contexts in each task, of
    seen less expected class counts at the context's features; tasks return
    at most one model-sized sum each, and there are 8 of them.  The bias
    starts at the log of the class frequencies, and the bigram weights at the
    log of the smoothed ratio to it; steps are scaled by each weight's
    gathered squared gradients.
    """
    shape = {"bigram": (CONTEXTS, CLASSES), "skip": (CONTEXTS, CLASSES), "trigram": (1 << TRIGRAMS_LOG2, CLASSES)}
    weights = {k: np.zeros(s, np.float32) for k, s in shape.items()}
    rows = counts.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("seen"))
    rows = cut_lineage(rows.select("context", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)),
                                                          lambda c: F.coalesce(F.try_element_at("seen", c), F.lit(0).cast("long"))).alias("seen")).repartition(8))
    start = counts.groupBy((F.col("context") % CONTEXTS).alias("b"), "class").agg(F.sum("n").alias("n")).collect()
    pair = np.zeros(shape["bigram"])
    for r in start:
        pair[r["b"], r["class"]] += r["n"]
    marginal = (pair.sum(axis=0) + ALPHA) / (pair.sum() + ALPHA * CLASSES)
    weights["bias"] = np.log(marginal).astype(np.float32)
    smooth = (pair + 20 * marginal) / (pair.sum(axis=1, keepdims=True) + 20)
    weights["bigram"] = (np.log(smooth) - np.log(marginal)).astype(np.float32)
    total = max(1.0, float(pair.sum()))
    squares = {k: np.full(s, 1e-12) for k, s in shape.items()}

    best, lowest, mark, since = weights, math.inf, math.inf, 0
    while True:
        sent = rows.sparkSession.sparkContext.broadcast(weights)

        def gradient(batches, sent=sent):
            sums = {k: np.zeros(s, np.float64) for k, s in shape.items()}
            loss = 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                context = batch.column("context").to_numpy().astype(np.int64)
                seen = np.stack(batch.column("seen").to_numpy(zero_copy_only=False)).astype(np.float64)
                logs = log_softmax(sent.value, context)
                loss -= float((seen * logs).sum())
                rest = seen - seen.sum(axis=1, keepdims=True) * np.exp(logs)
                for k, f in (("bigram", context % CONTEXTS), ("skip", context // CONTEXTS), ("trigram", _trigram(context))):
                    np.add.at(sums[k], f, rest)
            for k, s in sums.items():
                used = np.flatnonzero(np.abs(s).any(axis=1))
                data = (used.astype(np.int32).tobytes(), s[used].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([data[0]], pa.binary()), pa.array([data[1]], pa.binary())], names=["part", "used", "data"])
            yield pa.RecordBatch.from_arrays([pa.array(["loss"]), pa.array([b""], pa.binary()), pa.array([np.float64(loss).tobytes()], pa.binary())], names=["part", "used", "data"])

        g, loss = {k: np.zeros(s) for k, s in shape.items()}, 0.0
        for r in rows.mapInArrow(gradient, "part string, used binary, data binary").collect():
            if r["part"] == "loss":
                loss += np.frombuffer(r["data"])[0] / total
                continue
            used = np.frombuffer(r["used"], np.int32)
            g[r["part"]][used] += np.frombuffer(r["data"], np.float32).reshape(len(used), CLASSES)
        sent.destroy()
        since += 1
        if loss < lowest:
            best, lowest = weights, loss
        if loss < mark - tolerance:
            mark, since = loss, 0
        if since >= PATIENCE:
            return best
        step = {}
        for k in shape:
            g[k] /= total
            squares[k] += g[k] * g[k]
            step[k] = (weights[k] + rate * g[k] / np.sqrt(squares[k])).astype(np.float32)
        weights = {**weights, **step}


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    Learns from the rows with crc32(doc_id as text) mod 10 not 0; the others,
    and rows with a null doc_id, are held out.  A null or blank text is the
    end token alone.  Without training rows every token is unknown and both
    scores rest on the added counts.  Other columns are ignored.
    """
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 10 = 0, true)")
    docs = whole_texts(docs)
    train = docs.filter(~held)
    vocabulary = cut_lineage(word_counts(train))
    n_train = train.count()
    sums = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total, types = (sums[0] or 0) + n_train, sums[1] + (1 if n_train else 0)

    # a word longer than HEAD_BYTES stays with the others, however frequent
    top = vocabulary.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head, head_c = top["word"].combine_chunks().cast(pa.string()), top["c"].to_numpy().astype(np.float64)
    endings = frequent_endings(head.to_pylist(), head_c)
    classes = surface_class(head.to_pylist(), endings)
    classes[:SINGLES] = np.arange(1, 1 + SINGLES)[:len(classes)]
    lexicon = Lexicon(head, classes, endings)

    counts = cut_lineage(context_counts(train, lexicon))
    weights = train_classes(counts)

    # tokens and types of every class; words outside the head are classed where they are counted
    def class_sums(batches):
        for batch in batches:
            cls = surface_class(batch.column("word").to_pylist(), endings)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(np.bincount(cls, minlength=CLASSES), pa.int64())], names=["class", "v"])

    tokens_in = np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        tokens_in[r["class"]] = r["n"]
    types_in = np.zeros(CLASSES)
    for r in vocabulary.select("word").mapInArrow(class_sums, "class int, v long").groupBy("class").agg(F.sum("v").alias("v")).collect():
        types_in[r["class"]] = r["v"]
    # the single words were counted with the hashed class they would be in
    own = surface_class(head.slice(0, SINGLES).to_pylist(), endings)
    np.subtract.at(types_in, own, 1)
    sure = np.zeros(CLASSES, bool)
    sure[:1 + min(SINGLES, len(head))] = True
    within = np.where(sure, 0.0, -np.log10(tokens_in + ALPHA * (types_in + 1)))
    base_less = math.log10(total + ALPHA * (types + 1))
    head_log = np.log10(head_c + ALPHA)
    head_base, head_word = head_log, np.where(np.arange(len(head)) < SINGLES, 0.0, head_log)
    end_base = math.log10(n_train + ALPHA)
    table = np.concatenate([(log_softmax(weights, np.arange(k, k + CONTEXTS)) / math.log(10)).astype(np.float32) for k in range(0, CONTEXTS * CONTEXTS, CONTEXTS)])

    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for run in merged(batches):
            words, offsets = words_of(run.column("text"))
            row, cls = lexicon.of(words)
            tokens, context, text = _contexts(cls, offsets)
            n = run.num_rows
            size = np.diff(offsets)
            doc = np.repeat(np.arange(n), size)
            inside = np.bincount(text, table.ravel()[context * CLASSES + tokens], n) + np.bincount(doc, within[cls], n)
            known = row >= 0
            base = np.bincount(doc[known], head_base[row[known]], n) + end_base - base_less * (size + 1)
            model = inside + np.bincount(doc[known], head_word[row[known]], n)
            n_known = np.bincount(doc[known], minlength=n) + (1 if n_train else 0)
            # a text's own row has a word that no text can hold
            keys = pa.array([f" {r}" for r in run.column("row").to_pylist()])
            rare = pa.array(np.flatnonzero(~known))
            ids = run.column("doc_id")
            none = pa.nulls(len(rare))
            yield pa.RecordBatch.from_arrays(
                [run.column("row"), ids, run.column("held_out"), keys, pa.array(size + 1), pa.array(n_known), pa.array(base), pa.array(model)], names=names)
            yield pa.RecordBatch.from_arrays(
                [run.column("row").take(pa.array(doc[~known])), none.cast(ids.type), none.cast(pa.bool_()), words.take(rare),
                 none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())], names=names)

    names = ["row", "doc_id", "held_out", "word", "n_tokens", "n_head", "base", "model"]
    flat = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text").mapInArrow(
        score, f"row long, doc_id {kind}, held_out boolean, word string, n_tokens long, n_head long, base double, model double")
    # the vocabulary grows with the corpus, so it is never broadcast; head words, the frequent ones, are not in this join
    looked = flat.join(vocabulary.hint("shuffle_hash"), "word", "left")
    rare_log = F.sum(F.when(F.col("n_tokens").isNull(), F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).otherwise(0.0))
    done = looked.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
                                     (F.max("n_head") + F.count("c")).alias("n_known"), F.max("base").alias("base"), F.max("model").alias("model"), rare_log.alias("rare"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                       (F.col("base") + F.col("rare")).alias("base_score"), (F.col("model") + F.col("rare")).alias("score"))
