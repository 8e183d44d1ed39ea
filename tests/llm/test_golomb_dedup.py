import hashlib
import random

import numpy as np
import pytest

from strata.llm.golomb_dedup import _messages, exact_dedup, rice_decode, rice_encode, suspect_rows
from tests.llm.cases import docs_of, no_docs, odd_docs, rows


@pytest.mark.parametrize("n,top,shift", [(0, 10, 3), (1, 5, 0), (500, 600, 0), (500, 10**9, 20), (2000, 2**52, 41)])
def test_rice_round_trip(n, top, shift):
    prints = np.array(sorted(random.Random(n).sample(range(top), n)), np.uint64)
    assert (rice_decode(rice_encode(prints, shift), n, shift) == prints).all()


def test_messages_cover_the_block():
    prints = np.array([5, 5, 1, 900, 1023, 5], np.uint64)
    got = [(o, own.tolist(), twice.tolist()) for o, own, twice in _messages(prints, 10, 2)]
    assert got == [(0, [1, 5], [False, True]), (3, [900, 1023], [False, False])]


def brute(docs):
    norm = [(i, t or "", "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")) for i, t in docs]
    out = []
    for i, t, n in norm:
        group = [(-len(u), j is None, j if j is not None else 0, j) for j, u, m in norm if m == n]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("extra_bits", [0, 16])
def test_exact_dedup_against_brute_force(spark, extra_bits):
    docs = [(r[0], r[1]) for r in rows()]
    got = exact_dedup(odd_docs(spark), extra_bits).drop("suspect").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs)


def test_every_repeat_is_a_suspect_and_few_others(spark):
    texts = [f"text {i % 300} of many" for i in range(400)] + ["hot text"] * 300
    got = exact_dedup(docs_of(spark, texts).repartition(7))
    for r in got.collect():
        assert r.suspect == (r.group_size > 1) or r.group_size == 1
    assert got.filter("suspect and group_size = 1").count() <= 2
    assert got.filter("kept").count() == 301


def test_suspects_without_rows(spark):
    assert exact_dedup(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(1, 7)], "doc_id long, fingerprint long")
    assert suspect_rows(one).collect()[0].suspect is False
