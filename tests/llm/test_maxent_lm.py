import collections
import math
import re
import zlib

import numpy as np

from strata.llm import maxent_lm
from strata.llm.maxent_lm import CLASSES, CONTEXTS, END, log_softmax, score_texts, surface_class
from tests.llm.cases import docs_of, no_docs, odd_docs, rows


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["</s> "]


def base(docs):
    train = [tokens(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    return c, n, lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)


def check(got, docs):
    c, n, score = base(docs)
    texts = {i: tokens(t) for i, t in docs if i is not None}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
            assert abs(r.base_score - score(t)) < 1e-6 * max(1, abs(score(t)))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score < 0 and math.isfinite(r.score)


def test_odd_rows(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in rows()]
    got = score_texts(odd_docs(spark)).collect()
    assert len(got) == len(docs)
    check(got, docs)
    assert sum(r.doc_id is None and r.held_out for r in got) == 2


def test_words_outside_the_head(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD", 40)
    texts = [" ".join(f"w{(i * 7 + j * j) % 90}" for j in range(i % 30)) for i in range(120)]
    got = score_texts(docs_of(spark, texts)).collect()
    check(got, list(enumerate(texts)))


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """One-token texts: the model's probabilities of every word, of one
    unknown word in each class, and of the end, given the start."""
    texts = [" ".join(["the cat sat.", "a dog ran, then", "le chat dort"][i % 3] for _ in range(1 + i % 4)) for i in range(60)]
    c, _, _ = base(list(enumerate(texts)))
    known = sorted(w for w in c if w != "</s> ")
    # ids with crc32 % 10 = 0 are not learnt from
    held = [i for i in range(10_000, 60_000) if zlib.crc32(str(i).encode()) % 10 == 0][:len(known) + 1]
    docs = spark.createDataFrame(list(enumerate(texts)) + list(zip(held, ["", *known])), "doc_id long, text string")
    score = {r.doc_id: r.score for r in score_texts(docs).collect()}
    empty = 10 ** score[held[0]]
    assert 0 < empty < 1
    # p(word) p(end | word) <= p(word); all words and the end at once cannot pass 1
    assert empty + sum(10 ** score[i] for i in held[1:]) < 1


def test_class_softmax_is_a_distribution():
    r = np.random.default_rng(0)
    w = {"bias": r.normal(size=CLASSES), "bigram": r.normal(size=(CONTEXTS, CLASSES)), "skip": r.normal(size=(CONTEXTS, CLASSES)),
         "trigram": r.normal(size=(1 << maxent_lm.TRIGRAMS_LOG2, CLASSES))}
    p = np.exp(log_softmax(w, np.array([0, 5, CONTEXTS * CONTEXTS - 1])))
    assert np.allclose(p.sum(axis=1), 1)
    assert (surface_class(["abc", "abc.", "zbc", ""], {}) != END).all()
    assert surface_class(["abc"], {}) == surface_class(["zbc"], {}) != surface_class(["abc."], {})


def test_the_model_beats_the_base_where_order_matters(spark):
    texts = [" ".join(["red", "fox", "blue", "sea"] * 12) if i % 2 else " ".join(["un", "deux", "trois", "quatre"] * 12) for i in range(200)]
    got = [r for r in score_texts(docs_of(spark, texts)).collect() if r.held_out]
    assert got and all(r.score > 0.5 * r.base_score for r in got)


def test_no_rows_and_no_training_rows(spark):
    assert score_texts(no_docs(spark)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert abs(r.base_score) < 1e-9


def test_training_goes_on_until_the_loss_falls_no_more(spark):
    """Rows (context class pair, class, times): the class is that of both
    contexts together, which takes more than a few updates to learn."""
    r = np.random.default_rng(1)
    n = {(int(a) * CONTEXTS + int(b), int((a * b + a) % 7 + 1)): int(r.integers(1, 50)) for a in range(1, 30) for b in range(1, 30)}
    counts = spark.createDataFrame([(k, c, v) for (k, c), v in n.items()], "context int, class int, n long")
    context, cls, times = (np.array(x) for x in zip(*[(k, c, v) for (k, c), v in n.items()]))

    def loss(weights):
        return -(log_softmax(weights, context)[np.arange(len(cls)), cls] * times).sum() / times.sum()

    trained = loss(maxent_lm.train_classes(counts))
    assert trained < .1                                # 15 updates: .27


def test_frequent_words_are_told_apart_beyond_their_ending(spark):
    """A cycle of 45 words with one ending: each word is sure, given the one
    before, only where each is a class of its own."""
    cycle = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}xx" for i in range(45)]
    texts = [" ".join((cycle[i % 45:] + cycle[:i % 45]) * 4) for i in range(300)]
    got = [r for r in score_texts(docs_of(spark, texts)).collect() if r.held_out]
    assert got and all(r.score > -0.1 * r.n_tokens for r in got)    # 31 words of their own: -0.4
