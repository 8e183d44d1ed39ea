import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strata.llm.complement_packing import WordTable, _take, exact_fills, pack_documents, packing_plan
from tests.llm.cases import no_docs, odd_docs, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(counts, capacity):
    plan = packing_plan(counts, capacity)
    used = np.zeros_like(counts)
    for combo, n in plan:
        assert sum(combo) <= capacity and n > 0
        for x in combo:
            used[x] += n
    assert (used == counts).all()
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 64])
    counts = np.zeros(capacity + 1, np.int64)
    for _ in range(r.randrange(1, 300)):
        counts[r.randrange(1, capacity + 1)] += r.choice([1, 1, 5])
    n = check_plan(counts, capacity)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert least <= n <= least * 1.25 + 2


def test_exact_fills_of_one_two_and_three():
    counts = np.zeros(21, np.int64)
    counts[[12, 8, 5, 3, 4, 1]] = 1
    assert [c for c in exact_fills(counts, 12, 20) if _take(counts, c)] == [(12, 8), (12, 5, 3), (12, 4, 3, 1)]
    counts[8] = 0
    assert check_plan(counts, 20) == 2


def test_equal_parts_are_counted():
    counts = np.zeros(21, np.int64)
    counts[5] = 7
    assert check_plan(counts, 20) == 2
    assert packing_plan(np.zeros(21, np.int64), 20) == []


def test_words_share_rows_of_their_parts():
    import pyarrow as pa

    with open(PATH, encoding="utf-8") as f:
        table = WordTable(f.read())
    texts = ["don't Don't", "a's B'LL J̌ <|endoftext|>a <|ENDOFTEXT|> <|startoftext|>ΣΣ x\x1cy \x85 z\xa0w İ 12a!", "word, word. Word!! _x_ 'stop \"a\"", "... ...a a... 3. 3", "Ⅷ. ½! 中文。 é. É.", "ß µ ª º ÀÉÎÕÜ naïveté ÿ Ÿ ǅ ﬁ İi e\u0301 " + " ".join(chr(c) * 2 for c in range(33, 400))]
    for t in texts:
        for w in t.split(" "):
            assert table.lookup(pa.array([w]))[0].tolist() == table.tokenizer.encode(w, add_special_tokens=False).ids, w


def test_pieces_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    capacity = 64
    got = pack_documents(odd_docs(spark), PATH, capacity=capacity).collect()
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None and r[0] != 5}
    for d, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), capacity)) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert len([r for r in got if r.doc_id == 5]) % 2 == 0 and len([r for r in got if r.doc_id is None]) == 2
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(by) <= -(-sum(r.length for r in got) // capacity) + 1


def test_no_documents(spark):
    assert pack_documents(no_docs(spark), PATH).count() == 0


def test_forgotten_words_come_back(monkeypatch):
    import pyarrow as pa

    from strata.llm import complement_packing

    monkeypatch.setattr(complement_packing, "WORD_TABLE", 6)
    with open(PATH, encoding="utf-8") as f:
        table = WordTable(f.read())
    r = random.Random(0)
    for _ in range(60):
        words = [r.choice(["the", "the.", "of", "A", f"w{r.randrange(40)},", f"x{r.randrange(40)}", "..."]) for _ in range(5)]
        ids, size = table.lookup(pa.array(words))
        assert ids.tolist() == [i for w in words for i in table.tokenizer.encode(w, add_special_tokens=False).ids] and len(size) == 5


def test_every_cased_letter_before_punctuation():
    """A word may end in any letter that changes with its case, or in one that
    several code points make lower."""
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    table, library = WordTable(text), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    words = [f"{a}{c}{p}" for c in letters for a, p in (("a", "."), ("", "!?"), ("X", "-1"))]
    ids, size = table.lookup(pa.array(words))
    upto = np.concatenate([[0], np.cumsum(size)])
    wrong = [w for k, w in enumerate(words) if ids[upto[k]:upto[k + 1]].tolist() != library.encode(w, add_special_tokens=False).ids]
    assert "\u0130" in letters and not wrong
