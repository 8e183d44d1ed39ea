import random
import zlib

import numpy as np
import pyarrow as pa

from strata.llm import subword_quality
from strata.llm.subword_quality import _compact, classify_quality, features, fit, keep_good, score_quality, train
from tests.llm.cases import docs_of, no_docs, odd_docs, rows, words

LABELS = "doc_id long, quality int, score string"


def corpus(spark, n=400):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        w = words(r.randrange(5, 60), i, "abc")
        good = r.random() < 0.7
        style = r.randrange(3)
        texts.append(" ".join(w) if good else " ".join(w).upper() if style == 0 else " | ".join(w) if style == 1 else " ".join([w[0]] * len(w)))
        labels.append((i, int(good), None))
    return docs_of(spark, texts), spark.createDataFrame(labels, LABELS), labels


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = classify_quality(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, truth = corpus(spark, 150)
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, None) for i, q, _ in truth], LABELS)
    one, two = (fit(docs, x) for x in (labels, flipped))
    assert (one[0] == two[0]).all() and one[1] == two[1]


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, None), (1, 1, None), (8, 0, None), (None, 1, None), (9, None, None), (12, 1, None), (10, 7, None), (99, 0, None)], LABELS)
    got = classify_quality(docs, labels).collect()
    assert len(got) == len(rows()) and all(np.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.predicted)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in classify_quality(odd_docs(spark), none).collect()} == {0.5}
    assert classify_quality(no_docs(spark), none).count() == 0
    weights, bias = fit(odd_docs(spark), spark.createDataFrame([(1, 1, None), (6, 1, None)], LABELS))
    assert not weights.any() and bias in (0.0, 8.0)


def test_whole_texts_count(spark):
    """A score is the log odds of the mean over all features of the text."""
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1 << subword_quality.BUCKETS_LOG2).astype(np.float32)
    texts = ["a b  b c", "", "x" * 30_000 + " tail", "é 😀 ok ok"]
    got = {r.doc_id: r.score for r in score_quality(docs_of(spark, texts), weights, 0.25).collect()}
    for i, t in enumerate(texts):
        w = np.concatenate([weights[b] for b, _ in features(pa.array([t]))] or [np.zeros(0, np.float32)])
        want = 1 / (1 + np.exp(-((w.astype(np.float64).mean() if len(w) else 0) + 0.25)))
        assert abs(got[i] - want) < 1e-6


def test_features_do_not_depend_on_neighbours():
    one = _compact(pa.array(["some text here"]))[0]
    many = _compact(pa.array(["before", "some text here", "after it"]))[1]
    assert (one[0] == many[0]).all() and np.allclose(one[1], many[1]) and abs(one[1].sum() - 1) < 1e-5


def test_training_lowers_the_loss():
    sample = [(np.array([1, 2], np.int32), np.array([0.5, 0.5], np.float32)), (np.array([3, 4], np.int32), np.array([0.5, 0.5], np.float32))] * 20
    y = np.array([0, 1] * 20)
    v, o, b = train(sample, y)
    p = np.array([s @ v[k] @ (o[:, 1] - o[:, 0]) + b[1] - b[0] for k, s in sample])
    assert ((p > 0) == (y == 1)).all()


def test_contradicting_labels_and_repeated_rows(spark):
    """Labels of both classes for a document are passed over, and the row
    order of repeated documents does not matter."""
    docs, labels = [], []
    for i in range(60):
        docs.append((i, ("fine words here " if i % 2 else "zz qq zz ") * (1 + i % 4)))
        labels.append((i, i % 2))
    docs += [(i, "another text of the same document") for i in range(0, 60, 5)]
    more = [(i, 1 - i % 2) for i in range(0, 60, 7)]
    fits = []
    for turn in (1, -1):
        d = spark.createDataFrame(docs[::turn], "doc_id long, text string").repartition(3)
        fits.append(fit(d, spark.createDataFrame((labels + more)[::turn], "doc_id long, quality int")))
        fits.append(fit(d, spark.createDataFrame([x for x in labels if x[0] % 7], "doc_id long, quality int")))
    for w, b in fits[1:]:
        assert (w == fits[0][0]).all() and b == fits[0][1]
    only = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert fit(spark.createDataFrame(docs, "doc_id long, text string"), only)[1] == 8.0
