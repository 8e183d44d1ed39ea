import importlib
import subprocess
import sys

import corpus_pipeline
from strata.llm.circulant_minhash import near_components
from tests.llm.cases import words
from tests.llm.test_bootstrap_pii import brute as pii
from tests.llm.test_circulant_minhash import brute as near
from tests.llm.test_golomb_dedup import brute as copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, tmp_path):
    clean = [" ".join(words(30 + i % 20, i, "abc")) for i in range(120)]
    texts = list(clean)
    texts[50] = clean[3] + " "                     # a longer exact copy
    texts[51] = clean[4].replace(" ", "\n")        # an exact copy
    texts[52] = " ".join(clean[5].split()[:-1] + ["changed"])  # a near copy
    texts[53] = "mail me at some.one@mail.example.com or 10.20.30.40 " + clean[53]
    for i in range(60, 90):
        texts[i] = clean[i].upper() + " !!"
    labels = [(i, 0 if 60 <= i < 90 else 1, 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, None), (201, "", "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    docs = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "pii", "best-fit packing"]
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held.append({r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    good, unique, apart, safe, packed = held
    assert set(range(60)) | set(range(90, 120)) <= set(good) and not set(good) & set(range(62, 88))
    assert set(unique) == {i for i in good if "True" in next(x for x in copies([(j, r.text) for j, r in sorted(good.items())]) if x.startswith(f"({i},"))}
    assert 50 in unique and 3 not in unique and not {4, 51} <= set(unique)
    order = sorted(unique)
    assert set(apart) == {i for i, c in zip(order, near([(i, unique[i].text) for i in order])[1]) if i == c}
    assert set(safe) == set(apart) and 52 not in safe
    for i, r in safe.items():
        if pii(apart[i].text or ""):
            assert not pii(r.text) and r.n_chars == len(r.text) and "[EMAIL]" in r.text and "[IP]" in r.text
        else:
            assert r == apart[i]
    assert {r.doc_id for r in packed} == set(safe) and all(r.offset + r.length <= 2048 for r in packed)


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    docs = tables(spark, tmp_path)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")

    def key(df):
        return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())

    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


def test_stages_without_rows(spark, tmp_path):
    docs = tables(spark, tmp_path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert near_components(docs).count() == 0


def test_nothing_else_needs_this_package():
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'strata.llm') or name.startswith('strata.llm.'):\n"
            "            raise ModuleNotFoundError('gone', name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert 'a1_group_median' in q or len(q) > 200\n"
            "assert not any(n.startswith('op1') or n == 'pipeline' for n in q)\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("pathlib").Path(corpus_pipeline.__file__).parent)
