import numpy as np
import pytest
from pyspark.sql import types as T

from strata.llm import pivot_index
from strata.llm.pivot_index import unit, vector_links

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("size", T.StringType()), T.StructField("p", T.StringType())])


def brute(rows):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = {i: unit([np.array(r[1], np.float32)])[0] for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and ok(r[1])}
    for i in u:
        for j in u:
            if i < j and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and (rows[i][1] == rows[j][1] or u[i] @ u[j] >= 0.93):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return [(r[0], links[i], rows[find(i)][0]) for i, r in enumerate(rows)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in vector_links(df, **how).collect()), key=repr), df


def groups(seed, n, size, spread, dim=32, labels=3):
    r = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = r.normal(size=dim)
        for _ in range(size):
            out.append((len(out), (base / np.linalg.norm(base) + spread * r.normal(size=dim) / np.sqrt(dim)).astype(np.float32).tolist(), g % labels))
    return out


def test_awkward_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 1.0], 1),
            (10, [float("inf"), 1.0, 1.0], 1), (11, [1e-38, 2e-38, 3e-38], 1), (12, [1e38, 2e38, 3e38], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0, -3.0], 1), (None, a, 1), (1, a, 1), (15, [1.0, 2.0, 3.0001], 1)]
    got, _ = run(spark, rows)
    assert got == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("block", [7, 1000])
def test_links_against_brute_force(spark, monkeypatch, block):
    rows = groups(1, 12, 12, 0.25) + [(1000 + i, v, x) for i, v, x in groups(2, 1, 60, 0.15)]
    got, df = run(spark, rows, block=block)
    want = sorted(brute(rows), key=repr)
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert true > 1000 and 0.9 * true <= found <= true
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if found == true:
        assert got == want


def test_recall_of_borderline_links(spark):
    # pairs whose cosine is just above the threshold
    rows = groups(3, 300, 2, 0.265, dim=48, labels=4)
    got, _ = run(spark, rows)
    want = brute(rows)
    true = sum(w[1] for w in want)
    found = sum(g[1] for g in got)
    print("borderline recall", found, true)
    assert true > 100 and found >= 0.9 * true


def test_every_pair_is_counted_once(spark):
    # all vectors share all pivots: many lists hold the same pairs
    rows = groups(4, 1, 40, 0.02, labels=1)
    got, _ = run(spark, rows, per_root=8.0, block=9)
    assert all(g[1] == 39 and g[2] == 0 for g in got)


def test_no_rows(spark):
    assert vector_links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pivot_index.unit([[3.0, 4.0]]).tolist() == [[0.6, 0.8]]
