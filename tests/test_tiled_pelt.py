"""Tiled change points against the recursion over the whole kernel."""

import numpy as np
import pytest

from strata.operators import longitudinal as G
from strata.operators import tiled_pelt as P


def series(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    if kind == "noise":
        return rng.random(n)
    if kind == "steps":
        return np.repeat(rng.random(n // 40 + 1), 40)[:n] + rng.normal(0, .05, n)
    if kind == "ties":
        return rng.integers(0, 2, n).astype(float)
    return np.cumsum(rng.normal(0, 1, n))


@pytest.mark.parametrize("kind", ["noise", "steps", "ties", "walk"])
@pytest.mark.parametrize("least,n,min_size,penalty", [(7, 90, 2, 2.0), (16, 400, 2, 1.0), (5, 61, 3, .5), (8, 64, 20, 2.0), (300, 200, 2, 2.0)])
def test_tiles_give_the_same_ends(monkeypatch, kind, least, n, min_size, penalty):
    monkeypatch.setattr(P, "LEAST", least)
    monkeypatch.setattr(P, "CHUNK", 3)
    x = series(kind, n)
    x = (x - x.min()) / (x.max() - x.min() + 1e-8)
    med = G.median_squared_distance(x)
    gamma = 1.0 / med if med else 1.0
    tiles = -(-n // P.tile_size(n))
    assert tiles == max(1, -(-n // least))
    strips = [P.strip_sums(x, gamma, t) for t in range(tiles)]
    for t in range(tiles):
        for u in range(t):
            low = x[u * least:(u + 1) * least]
            assert np.allclose(strips[t][:, u], P.kernel(low, x[t * least:(t + 1) * least], gamma).sum(axis=0))
    assert P.pelt_from_strips(x, gamma, strips, penalty, min_size) == G.pelt_rbf(x, penalty, min_size)


def test_shorter_than_a_segment():
    x = np.array([0.0])
    assert P.pelt_from_strips(x, 1.0, [P.strip_sums(x, 1.0, 0)]) == G.pelt_rbf(x) == [1]


def test_long_and_short_series_of_a_table(spark):
    rows = [(s, i, float(v)) for s, n in ((1, 700), (2, 900), (3, 40), (4, 3)) for i, v in enumerate(series("steps", n))]
    rows += [(None, 1, 1.0), (1, 9999, None)]
    df = spark.createDataFrame(rows, "k long, n int, y double").withColumnRenamed("n", "x").repartition(5)
    tiled = {r["subject"]: r for r in G.change_points(df, "k", "x", "y", tile_from=500).collect()}
    plain = {r["subject"]: r for r in G.change_points(df, "k", "x", "y").collect()}
    assert set(plain) == {"1", "2", "3"} and tiled == plain and plain["1"]["n_points"] == 700 and plain["1"]["n_change_points"] > 3
    assert G.change_points(df.limit(0), "k", "x", "y").count() == 0


@pytest.mark.parametrize("n", [2, 3, 6, 41, 200])
def test_listed_pairs_and_bisection_give_the_same_median(monkeypatch, n):
    for kind in ("noise", "steps", "ties", "walk"):
        x = series(kind, n)
        listed = G.median_squared_distance(x)
        monkeypatch.setattr(G, "ALL_PAIRS", 1)
        assert listed == G.median_squared_distance(x)
        monkeypatch.undo()


def test_many_short_series_take_little_time_each():
    import time

    x = series("walk", 10)
    begin = time.process_time()
    for _ in range(200):
        G.median_squared_distance(x)
    assert time.process_time() - begin < .2           # bisection alone: 2 ms and more each


def test_series_run_over_batches():
    import pyarrow as pa

    k, y = [1] * 5 + [2] + [3] * 4, list(range(10))
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"k": k[i:i + size], "y": [float(v) for v in y[i:i + size]]}) for i in range(0, 10, size)]
        got = [(s, v[i:j].tolist()) for ks, v, cuts in G._series(batches) for s, i, j in zip(ks, cuts[:-1], cuts[1:])]
        assert got == [(1, [0, 1, 2, 3, 4]), (2, [5]), (3, [6, 7, 8, 9])]
