import public_tokenizers
import pytest
import sentencepiece

from strata.llm.chunk_pieces import ChunkTable, decode_pieces, encode_pieces
from tests.llm.cases import docs_of, no_docs, odd_docs, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(got, texts, library):
    for r in got.collect():
        ids = library.encode(texts[r.doc_id])
        assert r.ids == ids
        assert r.decoded == library.decode(ids)


def test_odd_rows(spark, library):
    got = decode_pieces(encode_pieces(odd_docs(spark), MODEL), MODEL)
    assert got.count() == len(rows())
    check(got.filter("doc_id is not null"), {r[0]: r[1] or "" for r in rows()}, library)


def test_white_space_and_markers(spark, library):
    texts = ["", " ", "  ", "a", "a ", " a", "  a  b ", "a▁b", "a▁ b", "▁", "▁a", " ▁ ", "a\n\n b\t\tc", " \n ", "x" * 5000, "\x00 a\x00b", "<0x0A>", "1234 5  678", "　a  b"]
    check(decode_pieces(encode_pieces(docs_of(spark, texts), MODEL), MODEL), dict(enumerate(texts)), library)


def test_no_rows_and_null_ids(spark):
    assert encode_pieces(no_docs(spark), MODEL).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in decode_pieces(none, MODEL).collect()] == ["", ""]


def test_table_starts_anew(library, monkeypatch):
    import pyarrow as pa

    from strata.llm import chunk_pieces

    monkeypatch.setattr(chunk_pieces, "CHUNK_TABLE", 2)
    with open(MODEL, "rb") as f:
        table = ChunkTable(f.read())
    for words in (["a", "b", "c"], ["d", "a"], ["a", "e", "a"]):
        ids, size = table.lookup(pa.array(words))
        assert ids.tolist() == [i for w in words for i in library.encode(w)] and len(size) == len(words)
