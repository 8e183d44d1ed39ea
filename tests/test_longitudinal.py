import datetime as dt

import numpy as np
import pandas as pd
import pytest

from strata.operators import longitudinal as G
from strata.operators import windows as W


def visits_frame():
    d = dt.date
    rows = [("a", 1, d(2020, 1, 1), 1.0),
            ("b", 2, d(2020, 1, 1), 1.0), ("b", 3, d(2020, 7, 1), 2.0),
            ("c", 4, d(2020, 1, 1), 0.5), ("c", 5, d(2020, 1, 1), 0.7), ("c", 6, d(2021, 1, 1), None),
            ("d", 7, d(2019, 1, 1), 0.1), ("d", 8, d(2019, 6, 1), 0.2), ("d", 9, d(2020, 1, 1), 0.4),
            ("d", 10, d(2020, 6, 1), 0.3), ("d", 11, d(2021, 1, 1), 0.9), ("d", 12, d(2021, 6, 1), 1.0)]
    return pd.DataFrame(rows, columns=["s", "k", "date", "y"])


def pandas_annualised(pdf):
    out = []
    for _, g in pdf.sort_values(["s", "date", "k"]).groupby("s", sort=False):
        g = g.copy()
        if len(g) <= 1:
            g["chg"] = np.nan
            g["ann"] = np.nan
        else:
            g["chg"] = g["y"] - g["y"].shift(1)
            days = (pd.to_datetime(g["date"]) - pd.to_datetime(g["date"]).shift(1)).dt.days
            g["ann"] = (g["chg"] * 365.25 / days.replace(0, np.nan))
        out.append(g)
    return pd.concat(out)


def test_annualised_change_matches_pandas(spark):
    pdf = visits_frame()
    got = G.annualised_change(spark.createDataFrame(pdf), "s", ["date", "k"], "date", "y").toPandas().set_index("k")
    exp = pandas_annualised(pdf).set_index("k")
    for k in exp.index:
        for a, b in (("y_change", "chg"), ("y_change_annual", "ann")):
            e, g = exp.loc[k, b], got.loc[k, a]
            assert (pd.isna(e) and pd.isna(g)) or g == pytest.approx(e)
    lo, hi = exp["ann"].quantile([0.05, 0.95])
    w = exp["ann"].clip(lo, hi)
    for k in exp.index:
        g = got.loc[k, "y_change_annual_winsorized"]
        assert (pd.isna(w[k]) and pd.isna(g)) or g == pytest.approx(w[k])


def test_rolling_mean_min_periods(spark):
    pdf = visits_frame()
    got = W.rolling_mean(spark.createDataFrame(pdf), "s", ["date", "k"], "y").toPandas().set_index("k")
    exp = pdf.sort_values(["s", "date", "k"]).groupby("s")["y"].transform(lambda x: x.rolling(3, min_periods=2).mean())
    for k, e in zip(pdf.sort_values(["s", "date", "k"])["k"], exp):
        g = got.loc[k, "y_rolling3"]
        assert (pd.isna(e) and pd.isna(g)) or g == pytest.approx(e)


def test_progression_pattern(spark):
    pdf = visits_frame().dropna(subset=["y"])
    got = G.progression_pattern(spark.createDataFrame(pdf), "s", ["date", "k"], "y").toPandas().set_index("s")
    assert "a" not in got.index                      # single visit excluded
    assert got.loc["b", "pattern"] == "progressive"  # 1.0 -> 2.0
    assert got.loc["c", "total_change"] == pytest.approx(0.2)
    assert got.loc["c", "pattern"] == "progressive"


def rbf_gram(x):
    """The kernel matrix the cost is defined by."""
    d2 = (x[:, None] - x[None, :]) ** 2
    med = float(np.median(d2[np.triu_indices(len(x), 1)])) if len(x) > 1 else 0.0
    scaled = np.clip(d2 * (1.0 / med if med else 1.0), 1e-2, 1e2)
    np.fill_diagonal(scaled, 0.0)
    return np.exp(-scaled)


def _dp_optimal(x, pen, min_size):
    """Brute-force optimal partitioning (no pruning) with the same cost."""
    n = len(x)
    k = rbf_gram(x)
    def cost(a, b):
        sub = k[a:b, a:b]
        return np.trace(sub) - sub.sum() / (b - a)
    best = {0: (0.0, [])}
    for t in range(min_size, n + 1):
        cands = [(best[s][0] + cost(s, t) + pen, best[s][1] + [t]) for s in best if t - s >= min_size]
        if cands:
            best[t] = min(cands, key=lambda z: z[0])
    return best[n][1]


@pytest.mark.parametrize("seed", range(6))
def test_pelt_equals_exhaustive(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, .1, 6), rng.normal(1, .1, 5), rng.normal(.3, .1, 7)])
    x = (x - x.min()) / (x.max() - x.min() + 1e-8)
    assert G.pelt_rbf(x, 2.0, 2) == _dp_optimal(x, 2.0, 2)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 51])
def test_median_squared_distance(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.zeros(n)):
        d2 = ((x[:, None] - x[None, :]) ** 2)[np.triu_indices(n, 1)]
        assert G.median_squared_distance(x) == (np.median(d2) if len(d2) else 0.0)


def test_long_series_are_analysed(spark):
    v = np.concatenate([np.zeros(3000), np.ones(3000)]) + np.random.default_rng(0).normal(0, .05, 6000)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)] + [(None, 1, 1.0)], "s string, k int, y double")
    r = G.change_points(df, "s", ["k"], "y").collect()
    assert len(r) == 1 and r[0]["n_points"] == 6000 and r[0]["change_points"] == [3000]


def test_trend_classes(spark):
    rows = []
    for i in range(6):
        rows.append(("up", i, float(i), 0.1 * i))          # steep significant slope
        rows.append(("flat", i, float(i), 0.5))             # constant
    rows += [("short", 0, 0.0, 1.0), ("short", 1, 1.0, 2.0)]
    rows += [("same_t", i, 1.0, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, k int, t double, y double")
    got = {r["s"]: r["pattern"] for r in G.classify_trend(df, "s", ["t", "k"], "t", "y").collect()}
    assert got == {"up": "progressive", "flat": "stable", "short": "insufficient_data", "same_t": "constant_time"}


def test_change_points_detects_step(spark):
    rows = [("s", i, float(i), 0.0 if i < 6 else 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, k int, t double, y double")
    r = G.change_points(df, "s", ["t", "k"], "y").collect()[0]
    assert r["change_points"] == [6]
