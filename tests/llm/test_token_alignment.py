import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strata.llm import text_chunks, token_alignment
from strata.llm.token_alignment import Aligner, _packed, _unpacked, aligned_tokens, coalesce, link_counts
from tests.llm.cases import docs_of, no_docs, odd_docs, rows
from tests.llm.test_simple8b import ODD, random_texts

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_letters():
    """The usual byte-level letters, by the rule in words: printable Latin-1
    bytes are themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = byte_letters()


def brute_groups(text, a, b):
    """[(ids of A, ids of B)] by walking both tokenisations."""
    if not text:
        return []
    whole = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = [set(np.cumsum([len(x) for x in t]).tolist()) for t in (bytes_a, bytes_b)]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for k, (ids, parts) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
        at = 0
        for i, p in zip(ids, parts):
            out[bisect_right(cuts, at)][k].append(i)
            at += len(p)
    return out


def brute(docs, a, b):
    """{place in docs: result row} over the whole list."""
    groups = [brute_groups(t, a, b) for _, t in docs]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = Counter(p for link in links for p in link)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), g, link in zip(docs, groups, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(link.values()), text,
                    sum(n for p, n in link.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in link.items())))
    return out


def results(spark, docs, paths=PATHS):
    return sorted(map(repr, map(tuple, link_counts(aligned_tokens(docs, *paths), *paths).collect())))


def test_coalesce():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(2, 60))
        cuts = [np.unique(np.append(r.integers(1, n, int(r.integers(0, n))), n)) for _ in range(2)]
        end = np.concatenate(cuts)
        start = np.concatenate([np.append(0, c[:-1]) for c in cuts])
        side = np.repeat([0, 1], [len(c) for c in cuts])
        order, group = coalesce(start, end, side)
        common = np.intersect1d(*cuts)
        assert (group == np.searchsorted(common, start[order], side="right")).all()
    assert len(coalesce(np.empty(0, int), np.empty(0, int), np.empty(0, int))[1]) == 0


def test_packing():
    for values in (np.empty(0, np.int64), np.array([0]), np.arange(5000) ** 3):
        assert (_unpacked(_packed(values)) == values).all()


@pytest.mark.parametrize("run_bytes,chunks", [(4_000_000, 400_000), (300, 40)])
def test_against_brute_force(spark, libraries, monkeypatch, run_bytes, chunks):
    monkeypatch.setattr(token_alignment, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", run_bytes)
    monkeypatch.setattr(text_chunks, "CHUNK_TABLE", chunks)
    r = random.Random(4)
    texts = ODD + random_texts(150, 6) + [" ".join(r.choice(["the", "tokenisation", "été", "don't", "x1y2", "日本"]) for _ in range(40)) for _ in range(30)]
    texts += [None, "▁", "a▁b c", "<s> </s> <unk> <0x41>", "x" * 3000, "日本語" * 200, "ab" * 400 + " " + "ba" * 400, " ".join(random_texts(100, 2))]
    docs = list(enumerate(texts))
    assert results(spark, docs_of(spark, texts).repartition(3)) == sorted(map(repr, brute(docs, *libraries)))


def test_odd_rows(spark, libraries):
    docs = [(r[0], r[1]) for r in rows()]
    got = results(spark, odd_docs(spark))
    assert got == sorted(map(repr, brute(docs, *libraries)))
    assert results(spark, no_docs(spark)) == []


def test_chunks_of_one_text_spell_it(libraries):
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        aligner = Aligner(f.read(), g.read())
    empty = aligner.align([])
    assert all(len(flat) == 0 for flat, _ in empty.values())
    assert aligner.align([" ▁", " a"])["ok"][0].tolist() == [0, 1]


def test_query_digests(spark, libraries):
    """The registered query on the smallest tables, from the libraries."""
    import hashlib

    from strata.llm.queries import op11_token_alignment

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:5], hashlib.sha256(r[5].encode()).hexdigest() if r[1] else "", *r[6:]) for r in brute(docs, *libraries)]
    got = op11_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
