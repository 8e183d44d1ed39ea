"""Models: grids, stacking, progression features, clusters, against numpy."""

import json

import numpy as np
import pandas as pd
import pytest

from strata.operators import ml as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 2))
    pdf = pd.DataFrame({"k": np.arange(160), "a": x[:, 0], "b": x[:, 1], "y": 2 * x[:, 0] - x[:, 1] + rng.normal(0, .1, 160)})
    pdf["c"] = (pdf["y"] > 0).astype(float)
    return pdf, M.assemble(spark.createDataFrame(pdf), ["a", "b"]).cache()


def test_ridge_is_the_sum_of_squares_problem(table):
    pdf, df = table
    n, alpha = len(pdf), 10.0
    m = M.grid_estimator("ridge", {"alpha": alpha}, "y", *M.size_and_sd(df, "y")).fit(df)
    x, y = pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(m.coefficients.toArray(), np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc), atol=1e-4)


def test_grid_search_reports_parameters(table):
    _, df = table
    grids = {"ridge": {"alpha": [0.1, 100.0]}, "random_forest": {"n_estimators": [3], "max_depth": [2, None], "min_samples_split": [2]}}
    got = M.grid_search(df, "y", "k", ("ridge", "random_forest"), k=3, grids=grids).collect()
    assert len(got) == 4 and sum(r["best"] for r in got) == 2
    best = {r["model"]: json.loads(r["params"]) for r in got if r["best"]}
    assert best["ridge"] == {"alpha": 0.1} and best["random_forest"]["max_depth"] is None


def test_stacking_predicts_through_the_refitted_models(table):
    pdf, df = table
    m = M.fit_stacking(df, "y", "k", k=4)
    oof = m.oof.toPandas().sort_values("k")
    z = oof[["pred_rf", "pred_ridge"]].to_numpy()
    zc, yc = z - z.mean(0), oof["y"] - oof["y"].mean()
    w = np.linalg.solve(zc.T @ zc + 0.1 * np.eye(2), zc.T @ yc)
    assert np.allclose(m.meta.coefficients.toArray(), w, atol=1e-3)
    out = m.transform(df).toPandas().sort_values("k")
    want = out[["pred_rf", "pred_ridge"]].to_numpy() @ w + oof["y"].mean() - z.mean(0) @ w
    assert np.allclose(out["prediction"], want, atol=1e-3)
    c = M.fit_stacking(df, "c", "k", k=3, task="classification").transform(df).toPandas()
    assert (c["prediction"] == c["c"]).mean() > 0.9


def test_class_weights_leave_rows_in_their_tasks(spark):
    from pyspark.sql import functions as F
    from tests.helpers import _RESTORE
    key = "spark.sql.autoBroadcastJoinThreshold"
    _RESTORE.append((key, spark.conf.get(key)))
    spark.conf.set(key, "-1")       # as where the rows are many
    df = spark.range(0, 800, 1, 8).withColumn("c", F.when(F.col("id") < 797, F.col("id") % 3))
    got = M.class_weights(df, "c").withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: r["class_weight"] for r in got if r.c is None} == {797: None, 798: None, 799: None} and len(got) == 800
    assert len({r.task for r in got}) == 8


@pytest.mark.parametrize("kind", ["logistic", "rf", "svm", "gbt"])
def test_classifier_kinds(table, kind):
    _, df = table
    p = M.fit_classifier(df.limit(120), "c", kind).transform(df).toPandas()
    assert (p["prediction"] == p["c"]).mean() > 0.85


def test_progression_features(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 3.0, 2.0), ("b", 0.0, 1.0), ("b", 2.0, 5.0), ("c", 0.0, 1.0), ("d", 1.0, 1.0), ("d", 1.0, 2.0), ("d", 1.0, 4.0),
            ("e", 0.0, 1.0), ("e", 1.0, None), ("e", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "s string, t double, y double")
    got = {(r["s"], r["t"], r["y"]): r for r in M.progression_features(df, "s", ["t", "y"], "t", "y").collect()}
    assert not any(k[0] == "c" for k in got) and len(got) == 11
    a = got[("a", 3.0, 2.0)]
    assert a["change_from_baseline"] == 1.0 and a["rate_of_change"] == -0.5 and a["max_value"] == 3.0 and a["min_value"] == 1.0
    assert a["overall_slope"] == pytest.approx(np.polyfit([0, 1, 3], [1, 3, 2], 1)[0]) and a["variability"] == pytest.approx(1.0)
    assert got[("b", 2.0, 5.0)]["overall_slope"] is None and got[("d", 1.0, 4.0)]["overall_slope"] == 0.0
    assert got[("d", 1.0, 2.0)]["rate_of_change"] is None and got[("e", 2.0, 3.0)]["overall_slope"] == 0.0


@pytest.mark.parametrize("method", ["kmeans", "gmm", "bisecting", "ward"])
def test_clusters_are_assigned(spark, method):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, .2, size=(40, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "k int, a double, b double")
    rows, scan, model = M.cluster_auto(df, ["a", "b"], method, range(2, 5))
    got = rows.toPandas().sort_values("k")
    assert len(got) == 120 and set(got.columns) == {"k", "a", "b", "cluster"}
    best = {r["k"]: r["best"] for r in scan.collect()}
    assert sum(best.values()) == 1 and got["cluster"].nunique() == next(k for k, b in best.items() if b)
    if method != "gmm":     # one start of a mixture may end in another optimum
        assert best[3] == 1 and all(got["cluster"].iloc[i:i + 40].nunique() == 1 for i in (0, 40, 80))
    else:
        bic = {r["k"]: r["bic"] for r in scan.collect()}
        assert min(bic, key=bic.get) == got["cluster"].nunique()
    assert model.transform(M.assemble(df.limit(3), ["a", "b"])).count() == 3


def test_registered_grid_searches_cover_all_kinds(spark, monkeypatch):
    import __spark_entry__ as E

    asked = []

    def search(df, label, key, kinds=tuple(M.GRIDS), **_):
        asked.extend(kinds)
        return df.sparkSession.createDataFrame([("", "", 0.0, 1)], "model string, params string, cv_rmse double, best int")

    monkeypatch.setattr(M, "grid_search", search)
    for name, query in E.queries().items():
        if name.startswith("m6_"):
            query(spark, "/root/testdata/sf0.001")
    assert sorted(asked) == sorted(M.GRIDS)
