"""Greedy one-to-one matching in rounds against the sequential algorithm."""

import numpy as np
import pandas as pd
import pytest

from strata.operators import joins as J


def sequential(left, right, tol):
    used, out = set(), {}
    for r in sorted(left.itertuples(), key=lambda r: (r.o, r.lid)):
        c = [(abs(x.rv - r.v), x.rid) for x in right.itertuples() if x.rb == r.b and abs(x.rv - r.v) <= tol and x.rid not in used]
        if c:
            used.add(min(c)[1])
            out[r.lid] = min(c)[1]
    return out


def tables(seed, n_left, n_right, spread, digits, blocks=1):
    rng = np.random.default_rng(seed)
    left = pd.DataFrame({"lid": np.arange(n_left), "o": rng.integers(0, n_left, n_left), "b": rng.integers(0, blocks, n_left),
                         "v": np.round(rng.uniform(0, spread, n_left), digits)})
    right = pd.DataFrame({"rid": rng.permutation(n_right) + 1000, "rb": rng.integers(0, blocks, n_right), "rv": np.round(rng.uniform(0, spread, n_right), digits)})
    return left, right


def match(spark, left, right, tol):
    got = J.greedy_match(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")], "lid", "o", "v", "rid", "rv", tol).collect()
    assert len({r["lid"] for r in got}) == len(got) == len({r["match_rid"] for r in got})
    v, rv = dict(zip(left["lid"], left["v"])), dict(zip(right["rid"], right["rv"]))
    assert all(r["diff"] == abs(rv[r["match_rid"]] - v[r["lid"]]) <= tol for r in got)
    return {r["lid"]: r["match_rid"] for r in got}


@pytest.mark.parametrize("seed,spread,digits,slots", [(0, 20, 0, 9), (1, 60, 1, 7), (2, 3, 0, 5), (3, 400, 2, 10), (4, 1, 0, 40)])
def test_rounds_end_in_the_sequential_result(spark, monkeypatch, seed, spread, digits, slots):
    """Many ranges, values that fill several of them, more left rows than
    right ones."""
    monkeypatch.setattr(J, "RANGE_SLOTS", slots)
    left, right = tables(seed, 90, 70, spread, digits)
    assert match(spark, left, right, 2.0) == sequential(left, right, 2.0)


def test_blocks_of_one_and_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(J, "RANGE_SLOTS", 12)
    left, right = tables(7, 150, 120, 30, 1, 4)
    right["rb"] = np.where(np.arange(120) < 80, 0, right["rb"])
    left["b"] = left["b"].where(left["b"] < 3, 9)      # a block without right rows
    assert match(spark, left, right, 1.5) == sequential(left, right, 1.5)


def test_one_range_and_odd_rows(spark):
    left, right = tables(8, 60, 50, 10, 1, 2)
    assert match(spark, left, right, 0.5) == sequential(left, right, 0.5)
    l = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, None, 1.0), ("c", None, "x", 1.0), ("d", 3, "x", None), ("e", 4, "x", float("nan"))],
                              "lid string, o int, b string, v double")
    r = spark.createDataFrame([("r1", "x", 1.0), ("r2", "x", 1.0), ("r3", None, 1.0), ("r4", "x", None)], "rid string, rb string, rv double")
    got = {x["lid"]: x["match_rid"] for x in J.greedy_match(l, r, [("b", "rb")], "lid", "o", "v", "rid", "rv", 0.0).collect()}
    assert got == {"a": "r1", "c": "r2"}
    assert J.greedy_match(l.limit(0), r, [("b", "rb")], "lid", "o", "v", "rid", "rv", 1.0).count() == 0
    assert J.greedy_match(l, r.limit(0), [("b", "rb")], "lid", "o", "v", "rid", "rv", 1.0).count() == 0


def test_large_integer_keys(spark, monkeypatch):
    """Keys beyond 2^53 stay what they are."""
    monkeypatch.setattr(J, "RANGE_SLOTS", 2)
    big = 1 << 60
    l = spark.createDataFrame([(big + i, big + 9 - i, 0, float(i)) for i in range(5)], "lid long, o long, b int, v double")
    r = spark.createDataFrame([(big + 2 * i + 1, 0, float(i)) for i in range(5)], "rid long, rb int, rv double")
    got = {x["lid"]: x["match_rid"] for x in J.greedy_match(l, r, [("b", "rb")], "lid", "o", "v", "rid", "rv", 3.0).collect()}
    assert got == {big + i: big + 2 * i + 1 for i in range(5)}


def test_a_dense_block_uses_all_tasks(spark, monkeypatch):
    """Each range of one block is its own group of rows."""
    monkeypatch.setattr(J, "RANGE_SLOTS", 500)
    left, right = tables(9, 4000, 4000, 1000, 3)
    left["o"] = left["lid"]
    got = match(spark, left, right, 0.4)
    order = np.argsort(right["rv"].to_numpy(), kind="stable")
    rv, rid = right["rv"].to_numpy()[order], right["rid"].to_numpy()[order]
    free, want = np.ones(len(rv), bool), {}
    for r in left.itertuples():
        a, b = np.searchsorted(rv, r.v - 0.4 - 1e-9), np.searchsorted(rv, r.v + 0.4 + 1e-9)
        c = [(abs(rv[i] - r.v), rid[i], i) for i in range(a, b) if free[i] and abs(rv[i] - r.v) <= 0.4]
        if c:
            free[min(c)[2]] = False
            want[r.lid] = min(c)[1]
    assert got == want
