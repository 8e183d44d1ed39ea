import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import circulant_minhash
from strata.llm.circulant_minhash import Circulant, near_components, shingle_sets
from tests.llm.cases import docs_of, no_docs, odd_docs, rows, words


def brute(docs):
    sets = []
    for _, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [docs[find(i)][0] for i in range(len(docs))]


def test_circulant_signature_estimates_jaccard():
    c, r = Circulant(64, 4), np.random.default_rng(0)
    a = r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
    for shared in (100, 200, 350):
        b = np.concatenate([a[:shared], r.integers(0, 2**63, 400 - shared).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
        same = (c.signature(a) == c.signature(b)).mean()
        assert abs(same - shared / (800 - shared)) < 0.12


def test_coordinates_are_shifts_of_one_permutation():
    c = Circulant(2, 3)
    assert (c.shifted[5][1:] == c.shifted[6][:-1]).all() and sorted(c.scatter.tolist())[:3] == [0, 1, 2]


def test_short_texts():
    got = [len(s) for s in shingle_sets(pa.array(["", " ", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a"]))]
    assert got == [0, 0, 1, 1, 1, 2, 1]


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    named = [d for d in docs if d[0] is not None]
    sizes, component = brute(named)
    got = {r.doc_id: r for r in near_components(odd_docs(spark)).collect() if r.doc_id is not None}
    for (i, _), n, c in zip(named, sizes, component):
        want = i if not n else c
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, want, i == want)
    unnamed = [r for r in near_components(odd_docs(spark)).collect() if r.doc_id is None]
    assert len(unnamed) == 2 and all(r.component_id is None and r.kept for r in unnamed)


@pytest.mark.parametrize("small_bucket,block", [(64, 500), (2, 500), (2, 5)])
def test_chains_and_borders_against_brute_force(spark, monkeypatch, small_bucket, block):
    monkeypatch.setattr(circulant_minhash, "BLOCK", block)
    r = random.Random(5)
    texts = []
    for g in range(6):
        base = words(120, 100 + g)
        for _ in range(r.choice([1, 8, 30])):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = "new" + str(r.randrange(999))
            base = w if r.random() < 0.5 else base
            texts.append(" ".join(w))
    sizes, component = brute(list(enumerate(texts)))
    got = {x.doc_id: x for x in near_components(docs_of(spark, texts).repartition(5), small_bucket=small_bucket).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == component


def test_no_documents(spark):
    assert near_components(no_docs(spark)).count() == 0
    assert near_components(docs_of(spark, ["", None, "one two"])).filter("kept").count() == 3
