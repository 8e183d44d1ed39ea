import numpy as np
import pandas as pd
import pytest

from strata.operators import impute as I


def knn_brute(pdf, feats, targets, k):
    """Reference kNN imputation: nan-Euclidean distance scaled by
    (all / shared coordinates), donors must have the target, mean of the k
    nearest (ties by key), column mean when no donor is comparable."""
    X = pdf[feats].to_numpy(float)
    keys = pdf["key"].to_numpy()
    out = pdf.copy()
    for t in targets:
        ti = feats.index(t)
        mean = np.nanmean(X[:, ti])
        for r in np.nonzero(np.isnan(X[:, ti]))[0]:
            cands = []
            for d in np.nonzero(~np.isnan(X[:, ti]))[0]:
                both = ~np.isnan(X[r]) & ~np.isnan(X[d])
                if both.sum() == 0:
                    continue
                dist = np.sqrt(((X[r, both] - X[d, both]) ** 2).sum() * len(feats) / both.sum())
                cands.append((dist, keys[d], X[d, ti]))
            cands.sort(key=lambda z: (z[0], z[1]))
            out.loc[out.index[r], t] = np.mean([c[2] for c in cands[:k]]) if cands else mean
    return out


@pytest.mark.parametrize("receivers,donors", [(2000, 20000), (7, 20000), (7, 11)])
def test_knn_imputation_matches_brute_force(spark, receivers, donors):
    rng = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({"key": np.arange(n), "a": rng.normal(0, 1, n).round(2), "b": rng.normal(5, 2, n).round(2),
                        "c": rng.integers(0, 4, n).astype(float)})
    pdf.loc[rng.choice(n, 12, replace=False), "a"] = np.nan
    pdf.loc[rng.choice(n, 9, replace=False), "b"] = np.nan
    feats = ["a", "b", "c"]
    got = I.impute_knn(spark.createDataFrame(pdf), "key", feats, ["a", "b"], k=3, receiver_rows=receivers, donor_rows=donors).toPandas()
    exp = knn_brute(pdf, feats, ["a", "b"], 3)
    got = got.sort_values("key").reset_index(drop=True)
    assert np.allclose(got[["a", "b"]].to_numpy(float), exp[["a", "b"]].to_numpy(float), atol=1e-9)


def test_knn_with_text_keys_and_many_ties(spark):
    """All donors are equally far: the k smallest keys are taken."""
    rows = [(f"k{i:02d}", 1.0, float(i), "g") for i in range(30)] + [("r", 1.0, None, "g")]
    df = spark.createDataFrame(rows, "key string, a double, b double, g string")
    got = {r["key"]: r["b"] for r in I.impute_knn(df, "key", ["a", "b"], ["b"], k=4, donor_rows=7).collect()}
    assert got["r"] == 1.5
    with pytest.raises(ValueError, match="not unique"):
        I.impute_knn(df.union(df.limit(1)), "key", ["a", "b"], ["b"])


def test_group_knn_keeps_rows_without_a_group(spark):
    rows = [(i, None if i % 14 == 0 else "ab"[i % 2], float(i % 7), None if i % 5 == 0 else float(i)) for i in range(70)]
    df = spark.createDataFrame(rows, "key int, g string, a double, b double")
    got = I.impute_by_group_knn(df, "key", "g", ["a", "b"], ["b"]).collect()
    assert sorted(r["key"] for r in got) == list(range(70)) and all(r["b"] is not None for r in got)
    lone = [r[3] for r in rows if r[1] is None and r[3] is not None]
    fill = {r["key"]: r["b"] for r in got}
    assert fill[0] == pytest.approx(np.median(lone)) and fill[14] == 14.0


def clustered(n: int, seed: int = 3) -> pd.DataFrame:
    """Rows in 40 tight clusters; values missing in frequent and rare patterns."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-100, 100, (40, 4))[rng.integers(0, 40, n)] + rng.normal(0, 0.5, (n, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.insert(0, "key", rng.permutation(n))
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.002, "c"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "d"] = np.nan
    return pdf


def test_pruned_knn_equals_all_pairs_and_tests_few(spark):
    """Exact on clustered rows with several missing patterns, and at least 10
    times fewer pairs than receivers x donors."""
    pdf, feats = clustered(12000), list("abcd")
    tested = spark.sparkContext.accumulator(0)
    got = I.impute_knn(spark.createDataFrame(pdf), "key", feats, ["a", "d"], k=4, receiver_rows=60, donor_rows=1000, tested=tested).toPandas()
    x, keys = pdf[feats].to_numpy(float), pdf["key"].to_numpy()
    present, full = ~np.isnan(x), 0
    exp = pdf.set_index("key")
    for t, j in (("a", 0), ("d", 3)):
        has = np.flatnonzero(present[:, j])
        for r in np.flatnonzero(~present[:, j]):
            both = present[r] & present[has]
            ss = np.where(both, np.nan_to_num(x[r]) - np.nan_to_num(x[has]), 0.0) ** 2
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(both.any(axis=1), np.sqrt(ss.sum(axis=1) * 4 / both.sum(axis=1)), np.inf)
            near = np.lexsort((keys[has], d))[:4]
            exp.loc[keys[r], t] = x[has[near[np.isfinite(d[near])]], j].mean() if np.isfinite(d).any() else np.nanmean(x[:, j])
    full = (~present[:, [0, 3]]).any(axis=1).sum() * len(x)
    got = got.set_index("key").loc[exp.index]
    assert np.allclose(got[feats].to_numpy(float), exp[feats].to_numpy(float), atol=1e-9, equal_nan=True)
    assert 0 < tested.value * 10 <= full, (tested.value, full)


def test_bounds_never_exceed_a_distance():
    from strata.operators.neighbours import lower_bounds, small_boxes
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (400, 5)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    boxes = small_boxes(x, 16)
    assert sorted(np.concatenate(boxes)) == list(range(400))
    with np.errstate(invalid="ignore"):
        lo, hi = (np.stack([f.reduce(x[b], axis=0) for b in boxes]) for f in (np.fmin, np.fmax))
    always, ever = (np.stack([f(~np.isnan(x[b]), axis=0) for b in boxes]) for f in (np.all, np.any))
    low = lower_bounds(x, lo, hi, always, ever)
    for i, b in enumerate(boxes):
        for r in range(0, 400, 7):
            for d in b:
                both = ~np.isnan(x[r]) & ~np.isnan(x[d])
                if both.any():
                    assert low[r, i] <= np.sqrt(((x[r] - x[d])[both] ** 2).sum() * 5 / both.sum()) * (1 + 1e-9)


def test_knn_of_empty_single_and_all_missing_rows(spark):
    df = spark.createDataFrame([], "key int, a double, b double")
    assert I.impute_knn(df, "key", ["a", "b"], ["b"]).collect() == []
    df = spark.createDataFrame([(1, None, None)], "key int, a double, b double")
    assert I.impute_knn(df, "key", ["a", "b"]).collect() == [(1, None, None)]
    df = spark.createDataFrame([(1, None, None), (2, 1.0, 4.0), (3, float("nan"), 8.0), (4, float("inf"), None)], "key int, a double, b double")
    got = {r["key"]: r["b"] for r in I.impute_knn(df, "key", ["a", "b"], ["b"]).collect()}
    assert got == {1: 6.0, 2: 4.0, 3: 8.0, 4: 6.0}
