import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import agg as A
from strata.operators import select as P
from strata.operators import windows as W


def test_first_non_null_per_column(spark):
    df = spark.createDataFrame([("k", 1, None, 7), ("k", 2, 5, 8)], "key string, o int, a int, b int")
    r = W.first_non_null(df, "key", ["o"], ["a", "b"]).collect()[0]
    assert (r["a"], r["b"]) == (5, 7)


def test_split_stratified_exact_counts(spark):
    pdf = pd.DataFrame({"k": np.arange(1000), "y": np.repeat(["a", "b", "c"], [600, 300, 100])})
    out = P.split_stratified(spark.createDataFrame(pdf), "k", "y", 0.8).toPandas()
    assert out.groupby("y")["is_train"].sum().to_dict() == {"a": 480, "b": 240, "c": 80}


def test_time_series_folds_cover_and_grow(spark):
    pdf = pd.DataFrame({"t": np.arange(60)})
    out = P.time_series_folds(spark.createDataFrame(pdf), ["t"], 5).toPandas()
    for f in range(5):
        tr = out[(out.fold == f) & (out.role == "train")]["row_no"]
        va = out[(out.fold == f) & (out.role == "validate")]["row_no"]
        assert tr.max() < va.min() and len(va) == 10 and len(tr) == 10 + 10 * f


def test_sample_stratified_quota(spark):
    pdf = pd.DataFrame({"k": np.arange(300), "y": np.repeat(["a", "b", "c"], [250, 45, 5])})
    out = P.sample_stratified(spark.createDataFrame(pdf), "k", "y", 60).toPandas()
    assert out.groupby("y").size().to_dict() == {"a": 20, "b": 20, "c": 5}


def test_crosstab_margins_normalized(spark):
    pdf = pd.DataFrame({"a": list("xxyyy"), "b": list("pqppq")})
    got = A.crosstab_long(spark.createDataFrame(pdf), "a", "b", "index", True).toPandas()
    exp = pd.crosstab(pdf.a, pdf.b, margins=True, normalize="index")
    for _, r in got.iterrows():
        if r["b"] != "All":
            assert r["share"] == pytest.approx(exp.loc[r["a"], r["b"]])


def test_welch_t_closed_form(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 9.0, 10.0]
    df = spark.createDataFrame([(0, v) for v in a] + [(1, v) for v in b], "g int, y double")
    r = A.welch_t(df, "g", "y", 0, 1).collect()[0]
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert r["t_stat"] == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt(va + vb))
    assert r["dof"] == pytest.approx((va + vb) ** 2 / (va ** 2 / 3 + vb ** 2 / 4))
    assert 0 < r["p_value"] < 0.1


def test_drop_sparse_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, None)], "k int, s double, e double")
    assert P.drop_sparse_columns(df, 0.5).columns == ["k"]
    assert P.drop_empty_columns(df).columns == ["k", "s"]
