import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strata.llm import text_chunks
from strata.llm.simple8b import BLOCK, ShardWriter, pack, read_shard, token_file_round_trip, unpack, write_token_files, read_token_files
from strata.llm.text_chunks import ByteLevel, ChunkTable, chunks_of
from tests.llm.cases import docs_of, no_docs, odd_docs, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mixed(n, seed):
    """Values of every width, in runs."""
    r = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < n:
        bits = int(r.integers(0, 65))
        out.append(r.integers(0, 2 ** bits - 1, int(r.integers(1, 200)), dtype=np.uint64, endpoint=True) if bits else np.zeros(130, np.uint64))
    return np.concatenate(out)[:n] if n else np.empty(0, np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 59, 1023, 1024, 1025, 20_000])
@pytest.mark.parametrize("block", [8, BLOCK])
def test_words_round_trip(n, block):
    ids = mixed(n, n)
    words, first, escapes = pack(ids, block)
    assert (unpack(words, first, escapes, n, block) == ids).all()
    assert len(first) == -(-n // block)


def greedy(ids):
    """The words of one block, one after the other."""
    from strata.llm.simple8b import COUNTS, WIDTHS

    words, i = [], 0
    while i < len(ids):
        for s in range(1, 16):
            part = ids[i:i + int(COUNTS[s])]
            if all(int(x) < 1 << int(WIDTHS[s]) for x in part):
                words.append((s << 60) | sum(int(x) << (j * int(WIDTHS[s])) for j, x in enumerate(part)))
                i += len(part)
                break
        else:
            words.append(0)
            i += 1
    return words


def test_words_are_the_longest_that_fit():
    for seed in range(20):
        ids = mixed(BLOCK, seed)
        words, _, escapes = pack(ids)
        words[(words >> np.uint64(60)) == 0] = 0
        assert words.tolist() == greedy(ids.tolist())
        assert len(escapes) == sum(int(x) >= 1 << 60 for x in ids)


def test_shard_and_random_access():
    r = np.random.default_rng(5)
    sizes = r.integers(0, 3000, 40)
    ids = mixed(int(sizes.sum()), 9)
    w = ShardWriter()
    for a, b in ((0, 7), (7, 8), (8, 40)):
        upto = np.concatenate([[0], np.cumsum(sizes)])
        w.add(np.arange(a, b) - 3, np.arange(a, b) != 5, sizes[a:b], ids[upto[a]:upto[b]])
    content = w.content()
    shard = read_shard(content)
    assert (shard.ids() == ids).all() and (np.diff(shard.ends.astype(int), prepend=0) == sizes).all()
    assert shard.doc_ids.tolist() == [i - 3 for i in range(40)] and shard.named.tolist().count(0) == 1
    for start, stop in ((0, 1), (1023, 1025), (1024, 2048), (5000, 9001), (len(ids) - 1, len(ids) + 9), (7, 7)):
        assert (shard.ids(start, stop) == ids[start:stop]).all()
    with pytest.raises(ValueError):
        read_shard(content[:100] + b"x" + content[101:])
    with pytest.raises(ValueError):
        read_shard(b"something else, long enough to have had a header of its own")
    empty = read_shard(ShardWriter().content())
    assert len(empty.ids()) == 0


ODD = ["", " ", "  ", "a", " a", "a  b", "a \nb", "a\n b", "a\n  b", "a   \n\n  b c", "x　y", "x 　y", "x  y", "a\u0085 b", "a \u0085b",
       "don't we'll 's 't", " ' s", "1234 567", "é è  ü", " ́x", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|>", "<|endoftext|>", "日本 語 の　テキスト", "😀 😀😀", "\x00 \x00", "﻿ a ﻿b",
       "tab\t x\t\ty", "a  b", "a　 　b", "w ᠎x", "w ​x", "fi st", " ", " \n", "\n "]


def random_texts(n, seed):
    r = random.Random(seed)
    bits = [" ", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "\x1c", "word", "The", "é", "日", "テ", "1", "23", "'s", "'", "!", "...", "😀", "́", "▁", "<", "|", "Ω", " ", "᠎", "﻿"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def test_chunks_hold_the_texts():
    texts = ODD + random_texts(500, 1)
    chunks, offsets = chunks_of(pa.array(texts))
    flat = chunks.to_pylist()
    assert ["".join(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])] == texts
    assert chunks_of(pa.array([], pa.string()))[1].tolist() == [0]
    sliced, at = chunks_of(pa.array(["zz z", *texts]).slice(1))
    assert sliced.to_pylist() == flat and (at == offsets).all()


def test_chunk_ids_are_the_librarys(library, monkeypatch):
    monkeypatch.setattr(text_chunks, "CHUNK_TABLE", 300)
    with open(PATH, encoding="utf-8") as f:
        coder = ByteLevel(f.read())
    table = ChunkTable(lambda c: {"ids": coder.encode(c)})
    library.encode_special_tokens = True
    for seed in range(12):
        texts = ODD + random_texts(400, seed)
        chunks, offsets = chunks_of(pa.array(texts))
        ids, size = table.take("ids", table.rows(chunks))
        upto = np.concatenate([[0], np.cumsum(size)])[offsets]
        for d, t in enumerate(texts):
            assert ids[upto[d]:upto[d + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    library.encode_special_tokens = False


def expected(docs, library):
    """Digest rows of documents in the given order."""
    out, start = [], 0
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), ids.tolist(), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, library, tmp_path):
    texts = ODD + random_texts(200, 3) + [" ".join(random_texts(3000, 4)), None]
    docs = docs_of(spark, texts).repartition(5)
    got = token_file_round_trip(docs, PATH, str(tmp_path / "files"))
    assert sorted(tuple(r) for r in got.collect()) == expected(list(enumerate(texts)), library)
    assert not [n for n in os.listdir(tmp_path / "files") if n.startswith(".") and n.endswith(".s8b")]


def test_small_files_and_blocks(spark, library, tmp_path):
    texts = random_texts(300, 8)
    docs = docs_of(spark, texts).repartition(4)
    files = write_token_files(docs, PATH, str(tmp_path), file_ids=100, block=16)
    assert files.count() > 20
    got = read_token_files(spark, str(tmp_path), files)
    assert sorted(tuple(r) for r in got.collect()) == expected(list(enumerate(texts)), library)
    ordered = [r.start for r in files.orderBy("file").collect()]
    assert ordered == sorted(ordered)


def test_odd_rows(spark, library):
    """Null ids come first, repeated ids stay rows, null texts are empty."""
    got = token_file_round_trip(odd_docs(spark), PATH).collect()
    assert len(got) == len(rows())
    plain = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    lengths = {}
    for r in got:
        if r.doc_id is not None:
            assert r.ids == [*library.encode(plain[r.doc_id], add_special_tokens=False).ids, 2]
        lengths[r.start] = r.n_tokens
    ends, at = 0, sorted(lengths)
    for s in at:
        assert s == ends
        ends += lengths[s]
    first = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in first] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))


def test_no_documents_and_wrong_ids(spark):
    assert token_file_round_trip(no_docs(spark), PATH).count() == 0
    with pytest.raises(TypeError):
        token_file_round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)
