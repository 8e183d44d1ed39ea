"""Penalised least squares side by side against Spark's fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import ml as M
from strata.operators import penalised as P


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * (1.0, 3.0, 0.2) + (0.0, 50.0, 1.0)
    y = 7 + x @ (2.0, -0.3, 0.0) + rng.normal(0, .3, 200)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = M.assemble(spark.createDataFrame(rows, "k int, a double, b double, c double, y double"), ["a", "b", "c"])
    return M.fold_column(df, "k", 3).cache()


def test_grid_errors_are_those_of_single_fits(folded):
    n, sd = M.size_and_sd(folded, "y")
    for kind, point in (("ridge", {"alpha": 10.0}), ("lasso", {"alpha": 0.1}), ("elastic_net", {"alpha": 0.1, "l1_ratio": 0.5})):
        got = M._linear_grid(kind, folded, "y", "k", [point], 3, "features")[0]
        for i, error in enumerate(got):
            model = M.grid_estimator(kind, point, "y", n * 2 / 3, sd).fit(folded.where(F.col("fold") != i))
            pred = model.transform(folded.where(F.col("fold") == i))
            assert error == pytest.approx(pred.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)))).first()[0], rel=1e-5)


def test_a_grid_takes_no_fit_of_its_own_for_a_point(folded, monkeypatch):
    def refuse(*_):
        raise AssertionError("fitted one by one")

    monkeypatch.setattr(M.LinearRegression, "fit", refuse)
    got = M.grid_search(folded.drop("fold"), "y", "k", ("ridge", "lasso", "elastic_net"), k=3)
    assert got.count() == 17 and got.where("cv_rmse IS NULL").count() == 0


def test_columns_and_labels_without_spread():
    x = np.column_stack([np.arange(6.0), np.full(6, 2.0), np.ones(6)])
    for y, w in ((3 * np.arange(6.0) + 1, [3.0, 0.0]), (np.full(6, 4.0), [0.0, 0.0])):
        z = np.column_stack([x, y])
        for l1 in (0.0, 1e-9):
            got, b = P.least_squares(z.T @ z, l1, 0.0)
            assert np.allclose(got, w, atol=1e-6) and b == pytest.approx(y[0], abs=1e-5)
