"""Masked Gram matrices and the Bayesian chained imputation on top of them."""

import numpy as np
import pandas as pd
import pytest

from strata.functions import gram as G
from strata.operators import agg as A
from strata.operators import impute as I
from tests.helpers import shuffle_partitions


def holes(n, p, seed, share=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e6
    x[rng.random((n, p)) < share] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])


def nulls(pdf):
    return [[None if isinstance(v, float) and np.isnan(v) else v for v in row] for row in pdf.to_numpy().tolist()]


@pytest.mark.parametrize("parts", [1, 5])
def test_wide_correlations_match_pandas(spark, parts):
    """163 columns with gaps, a constant one, one that is constant where it
    meets another, an empty one and one far from zero."""
    shuffle_partitions(spark, parts)
    pdf = holes(120, 163, 3)
    pdf["c5"] = 7.25
    pdf["c9"] = np.nan
    pdf["c11"] = np.where(np.arange(120) < 60, 1e8 + np.arange(120), np.nan)
    pdf["c12"] = np.where(np.arange(120) < 60, 0.1 + 0.2, np.arange(120.0))
    df = spark.createDataFrame(nulls(pdf), ", ".join(f"{c} double" for c in pdf)).repartition(4)
    got = A.corr_matrix(df, list(pdf)).toPandas().pivot(index="a", columns="b", values="corr").loc[list(pdf), list(pdf)]
    want = pdf.corr().to_numpy().copy()
    want[11, 12] = want[12, 11] = np.nan
    assert np.allclose(got.to_numpy(float), want, atol=1e-7, equal_nan=True)


def test_one_scan_for_all_pairs(spark):
    df = spark.createDataFrame(nulls(holes(20, 163, 4)), ", ".join(f"c{i} double" for i in range(163)))
    plan = A.corr_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("MapInArrow") == 1


def test_pair_sums_count_complete_rows(spark):
    rows = [(1.0, None, 2.0), (2.0, 3.0, None), (None, 1.0, float("nan")), (4.0, 5.0, 6.0)]
    got = {(r["i"], r["j"]): r for r in G.pair_sums(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], [0.0] * 3).collect()}
    assert [got[i, j]["n"] for i, j in ((0, 0), (0, 1), (0, 2), (1, 2), (2, 2))] == [3, 2, 2, 1, 2]
    r = got[0, 1]
    assert (r["sx"], r["sy"], r["sxx"], r["syy"], r["sxy"]) == (6.0, 8.0, 20.0, 34.0, 26.0)
    assert G.pair_sums(spark.createDataFrame([], "a double, b double"), ["a", "b"]).count() == 0


def ridge_by_svd(x, y):
    """Bayesian ridge on rows, by the singular values of the features."""
    n = len(x)
    xm, ym = x.mean(0), y.mean()
    x, y = x - xm, y - ym
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        coef = vt.T @ (s / (s ** 2 + lam / alpha) * (u.T @ y))
        gamma = (alpha * s ** 2 / (lam + alpha * s ** 2)).sum()
        lam = (gamma + 2e-6) / ((coef ** 2).sum() + 2e-6)
        alpha = (n - gamma + 2e-6) / (((y - x @ coef) ** 2).sum() + 2e-6)
        if old is not None and np.abs(old - coef).sum() < 1e-3:
            break
        old = coef
    coef = vt.T @ (s / (s ** 2 + lam / alpha) * (u.T @ y))
    return coef, ym - xm @ coef


def chained(x, rounds, tol):
    """The chained imputation in memory."""
    missing = np.isnan(x)
    cur = np.where(missing, np.nanmean(x, axis=0), x)
    order = sorted((c for c in range(x.shape[1]) if missing[:, c].any()), key=lambda c: (missing[:, c].sum(), f"c{c}"))
    top = np.abs(x[~missing]).max()
    for _ in range(rounds):
        before = cur.copy()
        for c in order:
            seen = ~missing[:, c]
            others = np.delete(cur, c, axis=1)
            coef, intercept = ridge_by_svd(others[seen], cur[seen, c])
            cur[~seen, c] = others[~seen] @ coef + intercept
        if np.abs(cur - before).sum(axis=1).max() < tol * top:
            break
    return cur


@pytest.mark.parametrize("rounds,tol", [(1, 0.0), (4, 0.0), (10, 1e-3)])
def test_chained_imputation_matches_numpy(spark, rounds, tol):
    pdf = holes(90, 4, 8) - 1e6
    pdf["k"] = [f"r{i}" for i in range(90)]
    df = spark.createDataFrame(nulls(pdf), "c0 double, c1 double, c2 double, c3 double, k string").repartition(3)
    got = I.impute_iterative(df, ["c0", "c1", "c2", "c3"], rounds, tol).toPandas()
    assert list(got.columns) == list(pdf.columns)
    got = got.set_index("k").loc[pdf["k"]].to_numpy(float)
    assert np.allclose(got, chained(pdf.drop(columns="k").to_numpy(float), rounds, tol), atol=1e-6)


def test_chained_imputation_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3.0), (2, None, None, float("inf")), (3, 3.0, None, 5.0)], "k int, a double, b double, c double")
    got = {r["k"]: r for r in I.impute_iterative(df, ["a", "b", "c"], 3).collect()}
    assert all(r["b"] is None and r["a"] is not None and np.isfinite(r["c"]) for r in got.values()) and got[2]["a"] == pytest.approx(2.0, abs=1.0)
    assert [r["a"] for r in I.impute_iterative(df, ["a"], 3).orderBy("k").collect()] == [1.0, 2.0, 3.0]
    assert I.impute_iterative(df.limit(0), ["a", "b"], 2).count() == 0
    full = df.select("k", F_one("a"), F_one("c"))
    assert sorted(map(tuple, I.impute_iterative(full, ["a", "c"]).collect())) == [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0)]


def F_one(name):
    from pyspark.sql import functions as F

    return F.lit(1.0).alias(name)
