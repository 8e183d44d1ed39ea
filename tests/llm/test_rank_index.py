import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import rank_index
from strata.llm.rank_index import MOST_ERROR, RankIndex, boundaries, fill_in_middle, restored_text
from tests.llm.cases import docs_of, no_docs, odd_docs, rows


def brute(i, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) of a document."""
    text = text or ""
    n = len(text)
    hexes = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * k:8 * k + 8], 16) for k in range(4))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def mixed_text(n, seed):
    """Stretches of letters of one to four bytes."""
    r, out = random.Random(seed), []
    while len(out) < n:
        letters = r.choice(["ab c", "aé", "日本", "😀é", "a日"])
        out += [r.choice(letters) for _ in range(r.randrange(1, 4000))]
    return "".join(out[:n])


@pytest.mark.parametrize("most", [0, 1, MOST_ERROR])
def test_every_boundary_is_found(most):
    texts = ["", "plain", "", mixed_text(5000 if most < 2 else 100_000, 1), "é", "日" * 300 + "a" * 300, ""]
    body, offsets, starts = boundaries(pa.array(texts))
    index = RankIndex(offsets, starts[:-1], most)
    assert (index.locate(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residual).max() <= most
    assert starts.tolist() == np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
    assert len(index.first) < len(offsets) / (20 if most == MOST_ERROR else 1)


def test_fitted_in_slices(monkeypatch):
    monkeypatch.setattr(rank_index, "AT_ONCE", 500)
    _, offsets, starts = boundaries(pa.array([mixed_text(9000, 2), "", "a" * 2000, "é"]))
    index = RankIndex(offsets, starts[:-1])
    assert (index.locate(np.arange(len(offsets))) == offsets).all()
    assert np.diff(index.first).max() <= 500


def test_one_line_for_one_width():
    _, offsets, starts = boundaries(pa.array(["x" * 10_000]))
    assert len(RankIndex(offsets, starts[:-1]).first) == 1
    assert boundaries(pa.array([], pa.string()))[1].tolist() == [0]
    _, offsets, starts = boundaries(pa.array(["skipped", "é", "ab"]).slice(1))
    assert offsets.tolist() == [0, 2, 3, 4] and starts.tolist() == [0, 1, 3]


def test_outputs_and_restored_texts(spark):
    texts = [mixed_text(random.Random(i).randrange(0, 300), i) for i in range(400)]
    texts += ["<P>", "a<S>b", "x<M>", "<P", "<", "<S", "S>a<", "<<P", "\x00 \x00", "a\r\nb", None, "", mixed_text(200_000, 7)]
    got = fill_in_middle(docs_of(spark, texts).repartition(4))
    back = {r.doc_id: r for r in got.withColumn("back", restored_text(got.output, got.form)).collect()}
    assert len(back) == len(texts)
    for i, t in enumerate(texts):
        r = back[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(i, t)
        assert r.back == (t or "")
    assert {r.form for r in back.values()} == {"plain", "psm", "spm"}


def test_marks_met_halfway(spark):
    """Texts of the marks' own letters, cut everywhere."""
    r = random.Random(3)
    texts = ["".join(r.choice("<PSM>") for _ in range(r.randrange(1, 9))) for _ in range(600)]
    got = fill_in_middle(docs_of(spark, texts), seed=5, plain_percent=0, spm_percent=50)
    for row in got.withColumn("back", restored_text(got.output, got.form)).collect():
        assert row.back == texts[row.doc_id]
        assert (row.form == "plain") == any(m in texts[row.doc_id] for m in ("<P>", "<S>", "<M>"))


def test_odd_rows(spark):
    got = fill_in_middle(odd_docs(spark)).collect()
    want = [(i, *brute(i, t)) for i, t, *_ in rows()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fill_in_middle(no_docs(spark)).count() == 0


def test_string_ids(spark):
    got = fill_in_middle(spark.createDataFrame([("k", "some text")], "doc_id string, text string")).first()
    assert tuple(got) == ("k", *brute("k", "some text"))
