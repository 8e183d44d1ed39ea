"""Model training and evaluation M1-M25.

Modelling table: one row per order -- label = total price / 654321, features
= customer balance and nation, line count, total quantity, mean discount and
tax (aggregated from ``lineitem``), priority digit; the class label is the
order status.  Metric operators are checked on fixed (y, yhat) pairs:
``labels`` (quality vs toxic; document length as score) and ``lineitem``.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators.scale import scale_standard
from ..operators.select import split_random
from ..session import cut_lineage, ensure_checkpoint_dir
from .longitudinal import KEY, ORDER, SCALE, VISITS, visits
from .registry import register, rounded, table

FEATS = ["c_acctbal", "c_nationkey", "n_lines", "qty", "disc", "tax", "prio"]


def model_table(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left")
    return j.select("o_orderkey", (F.col("o_totalprice") / SCALE).alias("y"), "o_orderstatus",
                    "c_acctbal", "c_nationkey", "n_lines", "qty", "disc", "tax",
                    F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"))


def prepared(spark, sf):
    df, feats = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    # written once: every fit and every fold reads the matrix
    return cut_lineage(M.assemble(split_random(df, "o_orderkey"), feats)), feats


M1_SQL = f"""WITH li AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, o_totalprice / {SCALE} AS y, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
  CAST(n_lines AS DOUBLE) AS n_lines, qty, disc, tax, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS prio
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, round(y, 6) AS y, """ + ", ".join(
    f"round(CASE WHEN coalesce({c}, (SELECT median({c}) FROM t)) IS NULL THEN NULL ELSE least(greatest(coalesce({c}, (SELECT median({c}) FROM t)), "
    f"(SELECT quantile_cont({c}, 0.05) FROM t)), (SELECT quantile_cont({c}, 0.95) FROM t)) END, 6) AS {c}" for c in FEATS) + " FROM t"


@register("m1_prepare_matrix", M1_SQL)
def m1(spark, sf):
    df, _ = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    return rounded(df)


@register("m2_fit_linear")
def m2(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_linear(d.where("is_train = 1"), "y", l2=0.01)
    return rounded(M.regression_metrics(m.transform(d.where("is_train = 0")), "y", "prediction"))


@register("m3_fit_trees_reg")
def m3(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_trees_reg(d.where("is_train = 1"), "y", "rf")
    return rounded(M.regression_metrics(m.transform(d.where("is_train = 0")), "y", "prediction"))


@register("m3_fit_boosted_reg")
def m3b(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_trees_reg(d.where("is_train = 1"), "y", "gbt")
    return rounded(M.regression_metrics(m.transform(d.where("is_train = 0")), "y", "prediction"))


@register("m3_fit_second_order")
def m3c(spark, sf):
    """Second-order boosting on the raw features, nulls included."""
    d = cut_lineage(split_random(model_table(spark, sf).where("y IS NOT NULL"), "o_orderkey"))
    m = M.fit_second_order(d.where("is_train = 1"), "y", "o_orderkey", FEATS)
    return rounded(M.regression_metrics(m.predict(d.where("is_train = 0")), "y", "prediction"))


def cls_table(spark, sf):
    df, feats = M.prepare_matrix(model_table(spark, sf).drop("y"), "o_orderstatus", keep=["o_orderkey"])
    from ..operators.scale import label_encode
    df = label_encode(df, "o_orderstatus", "label").withColumn("label", F.col("label").cast("double"))
    return cut_lineage(M.assemble(split_random(df, "o_orderkey"), feats)), feats


def _classifier_scores(d, kinds):
    parts = []
    for kind in kinds:
        m = M.fit_classifier(d.where("is_train = 1"), "label", kind)
        parts.append(M.classification_metrics(m.transform(d.where("is_train = 0")), "label", "prediction").withColumn("model", F.lit(kind)))
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@register("m4_fit_classifier")
def m4(spark, sf):
    return _classifier_scores(cls_table(spark, sf)[0], ("logistic", "rf", "svm"))


@register("m4_fit_boosted_classifier")
def m4b(spark, sf):
    """Boosted trees on open orders against all others."""
    d, _ = cls_table(spark, sf)
    return _classifier_scores(d.withColumn("label", (F.col("o_orderstatus") == "O").cast("double")), ("gbt",))


@register("m5_class_weights", """WITH c AS (SELECT o_orderstatus, count(*) AS nc FROM orders GROUP BY 1)
SELECT o_orderkey, round((SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(*) FROM c) * nc), 6) AS class_weight FROM orders JOIN c USING (o_orderstatus)""")
def m5(spark, sf):
    return rounded(M.class_weights(table(spark, sf, "orders"), "o_orderstatus").select("o_orderkey", "class_weight"))


@register("m6_grid_search")
def m6(spark, sf):
    """The linear kinds; each grid point is fitted on 5 folds."""
    d, feats = prepared(spark, sf)
    z = M.assemble(scale_standard(d.drop("features"), feats, suffix="_z"), [f"{c}_z" for c in feats])
    return rounded(M.grid_search(z, "y", "o_orderkey", ("ridge", "lasso", "elastic_net")))


@register("m6_grid_search_svr")
def m6s(spark, sf):
    """The linear support-vector grid on 5 folds, all models side by side."""
    d, feats = prepared(spark, sf)
    z = M.assemble(scale_standard(d.drop("features"), feats, suffix="_z"), [f"{c}_z" for c in feats])
    return rounded(M.grid_search(z, "y", "o_orderkey", ("linear_svr",)))


@register("m6_grid_search_forest")
def m6b(spark, sf):
    """All forest grid points on 5 folds; trees need no scaling."""
    d, feats = prepared(spark, sf)
    return rounded(M.grid_search(d, "y", "o_orderkey", ("random_forest",), features=feats))


@register("m6_grid_search_boosting")
def m6c(spark, sf):
    """All boosting grid points on 5 folds."""
    d, feats = prepared(spark, sf)
    return rounded(M.grid_search(d, "y", "o_orderkey", ("gradient_boosting",), features=feats))


@register("m7_cross_validate")
def m7(spark, sf):
    d, _ = prepared(spark, sf)
    return rounded(M.cross_validate(d, LinearRegression(featuresCol="features", labelCol="y"), "y", "o_orderkey", k=5))


@register("m8_regression_metrics", """WITH p AS (SELECT l_extendedprice / 100000.0 AS y, l_quantity / 50.0 AS yhat FROM lineitem)
SELECT metric, round(value, 6) AS value FROM (SELECT 'rmse' AS metric, sqrt(avg((y - yhat) * (y - yhat))) AS value FROM p
  UNION ALL SELECT 'mae', avg(abs(y - yhat)) FROM p
  UNION ALL SELECT 'r2', 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) FROM p)""")
def m8(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100000.0).alias("y"), (F.col("l_quantity") / 50.0).alias("yhat"))
    return rounded(M.regression_metrics(li, "y", "yhat"))


M9_SQL = """WITH p AS (SELECT quality AS y, toxic AS yhat FROM labels WHERE quality IS NOT NULL),
cls AS (SELECT y AS cls FROM p UNION SELECT yhat FROM p),
per AS (SELECT cls, (SELECT count(*) FROM p WHERE y = cls) AS support, (SELECT count(*) FROM p WHERE yhat = cls) AS pred,
  (SELECT count(*) FROM p WHERE y = cls AND yhat = cls) AS tp FROM cls),
m AS (SELECT *, coalesce(tp / nullif(pred, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc FROM per),
f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM m)
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, sum(tp) / sum(support) AS value FROM f
  UNION ALL SELECT 'precision_weighted', sum(pr * support) / sum(support) FROM f
  UNION ALL SELECT 'recall_weighted', sum(rc * support) / sum(support) FROM f
  UNION ALL SELECT 'f1_weighted', sum(f1 * support) / sum(support) FROM f
  UNION ALL SELECT 'f1_macro', avg(f1) FILTER (WHERE support > 0) FROM f
  UNION ALL SELECT 'recall_class_' || CAST(cls AS VARCHAR), rc FROM f WHERE support > 0)"""


@register("m9_classification_metrics", M9_SQL)
def m9(spark, sf):
    return rounded(M.classification_metrics(table(spark, sf, "labels"), "quality", "toxic"))


@register("m10_auc", """WITH d AS (SELECT CAST(quality = 1 AS INTEGER) AS pos, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
SELECT round((sum(rk) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (count(*) - sum(pos))), 6) AS auc FROM r""")
def m10(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(M.auc(d, "quality", "n_chars"))


def _m11(spark, sf):
    """Metrics of three fixed-rule predictors of the line price, compared."""
    li = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100000.0).alias("y"),
                                             (F.col("l_quantity") / 50.0).alias("p_qty"),
                                             (F.col("l_quantity") * F.col("l_discount")).alias("p_disc"),
                                             (F.col("l_tax") * 10).alias("p_tax"))
    rows = None
    for p in ("p_qty", "p_disc", "p_tax"):
        m = M.regression_metrics(li, "y", p).groupBy().pivot("metric", ["rmse", "mae", "r2"]).agg(F.first("value"))
        m = m.withColumn("model", F.lit(p))
        rows = m if rows is None else rows.unionByName(m)
    return rounded(M.compare_models(rows))


M11_SQL = """WITH li AS (SELECT l_extendedprice / 100000.0 AS y, l_quantity / 50.0 AS p_qty, l_quantity * l_discount AS p_disc, l_tax * 10 AS p_tax FROM lineitem),
m AS (SELECT 'p_qty' AS model, sqrt(avg((y - p_qty) ^ 2)) AS rmse, avg(abs(y - p_qty)) AS mae, 1 - sum((y - p_qty) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM li
  UNION ALL SELECT 'p_disc', sqrt(avg((y - p_disc) ^ 2)), avg(abs(y - p_disc)), 1 - sum((y - p_disc) ^ 2) / (var_pop(y) * count(*)) FROM li
  UNION ALL SELECT 'p_tax', sqrt(avg((y - p_tax) ^ 2)), avg(abs(y - p_tax)), 1 - sum((y - p_tax) ^ 2) / (var_pop(y) * count(*)) FROM li),
s AS (SELECT *, 0.4 * r2 + 0.3 * (1 - rmse / max(rmse) OVER ()) + 0.3 * (1 - mae / max(mae) OVER ()) AS ws FROM m)
SELECT model, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(ws, 6) AS weighted_score,
  CAST(row_number() OVER (ORDER BY ws DESC, model) AS INTEGER) AS rank FROM s"""

register("m11_compare_models", M11_SQL)(_m11)


@register("m12_importance")
def m12(spark, sf):
    d, feats = prepared(spark, sf)
    return rounded(M.importance(spark, M.fit_trees_reg(d, "y", "rf"), feats, 5))


@register("m13_vote", """SELECT l_orderkey, l_linenumber, round((l_quantity / 50.0 + l_discount * 10 + l_tax * 10) / 3, 6) AS vote_mean,
  CASE WHEN (l_returnflag = l_linestatus) OR (l_returnflag = 'A') THEN l_returnflag ELSE least(l_returnflag, l_linestatus, 'A') END AS vote_hard FROM lineitem""")
def m13(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("a"),
                                             (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"),
                                             "l_returnflag", "l_linestatus", F.lit("A").alias("third"))
    v = M.vote(li, ["a", "b", "c"], "mean", "vote_mean")
    v = _hard_vote(v, ["l_returnflag", "l_linestatus", "third"], "vote_hard")
    return rounded(v.select("l_orderkey", "l_linenumber", "vote_mean", "vote_hard"))


def _hard_vote(df, cols, out):
    from ..operators.risk import consensus_stratum
    # majority label; ties -> smallest label (sorted before counting)
    arr = F.array_sort(F.array(*[F.col(c) for c in cols]))
    tmp = df.withColumn("_srt", arr).select("*", *[F.col("_srt")[i].alias(f"_v{i}") for i in range(len(cols))])
    return consensus_stratum(tmp, [f"_v{i}" for i in range(len(cols))], out).drop("_srt", *[f"_v{i}" for i in range(len(cols))])


@register("m14_fit_bagging")
def m14(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_bagging(d.where("is_train = 1"), "y", 10)
    return rounded(M.regression_metrics(m.transform(d.where("is_train = 0")), "y", "prediction"))


@register("m15_fit_stacking")
def m15(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_stacking(d.where("is_train = 1"), "y", "o_orderkey")
    return rounded(m.transform(d.where("is_train = 0")).select("o_orderkey", "y", "pred_rf", "pred_ridge", "prediction"))


@register("m15_stacking_oof")
def m15b(spark, sf):
    d, _ = prepared(spark, sf)
    return rounded(M.fit_stacking(d.where("is_train = 1"), "y", "o_orderkey").oof)


@register("m15_fit_stacking_classifier")
def m15c(spark, sf):
    d, _ = cls_table(spark, sf)
    m = M.fit_stacking(d.where("is_train = 1"), "label", "o_orderkey", task="classification")
    return m.transform(d.where("is_train = 0")).select("o_orderkey", "label", "pred_rf", "pred_lr", "prediction")


@register("m16_fit_experts")
def m16(spark, sf):
    df, _ = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    out = M.fit_experts(df, "y", {"customer": ["c_acctbal", "c_nationkey"], "lines": ["n_lines", "qty", "disc", "tax"]}, "o_orderkey")
    return rounded(out.select("o_orderkey", "y", "expert_customer", "expert_lines"))


PROGRESSION = ["change_from_baseline", "rate_of_change", "overall_slope", "max_value", "min_value", "variability"]


def progression_table(spark, sf):
    return M.progression_features(visits(spark, sf), KEY, ORDER, "t_months", "score")


@register("m17_progression_features", f"""WITH {VISITS}, n AS (SELECT *, count(*) OVER s AS n,
  score - first_value(score) OVER o AS change_from_baseline,
  (score - lag(score) OVER o) / nullif(t_months - lag(t_months) OVER o, 0) AS rate_of_change,
  coalesce(covar_pop(score, t_months) OVER s / nullif(var_pop(t_months) OVER s, 0), 0) AS slope,
  max(score) OVER s AS max_value, min(score) OVER s AS min_value, stddev_samp(score) OVER s AS variability
  FROM visits WINDOW s AS (PARTITION BY subject), o AS (PARTITION BY subject ORDER BY visit_date, visit_id))
SELECT visit_id, round(change_from_baseline, 6) AS change_from_baseline, round(rate_of_change, 6) AS rate_of_change, round(CASE WHEN n >= 3 THEN slope END, 6) AS overall_slope,
  round(max_value, 6) AS max_value, round(min_value, 6) AS min_value, round(variability, 6) AS variability FROM n WHERE n >= 2""")
def m17f(spark, sf):
    return rounded(progression_table(spark, sf).select("visit_id", *PROGRESSION))


@register("m17_fit_progression")
def m17(spark, sf):
    return rounded(M.fit_progression(progression_table(spark, sf), "score", [*PROGRESSION, "ordinal", "t_months"], "visit_id"))


def _cluster_input(spark, sf):
    df, _ = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    return scale_standard(df, ["qty", "disc", "c_acctbal"], suffix="_z")


CLUSTER_BY = ["qty_z", "disc_z", "c_acctbal_z"]


@register("m18_fit_kmeans_auto")
def m18(spark, sf):
    return rounded(M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "kmeans")[1])


@register("m21_phenotype_profile")
def m21c(spark, sf):
    """Profile of the clusters that bisecting k-means finds."""
    rows = M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "bisecting")[0]
    return rounded(M.cluster_profile(rows, "cluster", "y", ["qty", "disc", "c_acctbal"]))


@register("m19_fit_gmm_auto")
def m19(spark, sf):
    return rounded(M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "gmm")[1])


@register("m19_gmm_assignment")
def m19b(spark, sf):
    return M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "gmm")[0].select("o_orderkey", "cluster")


@register("m20_fit_ward_auto")
def m20w(spark, sf):
    return rounded(M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "ward")[1])


@register("m20_ward_assignment")
def m20wa(spark, sf):
    return M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "ward")[0].select("o_orderkey", "cluster")


@register("m20_fit_bisecting_auto")
def m20(spark, sf):
    return rounded(M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "bisecting")[1])


@register("m20_bisecting_assignment")
def m20b(spark, sf):
    return M.cluster_auto(_cluster_input(spark, sf), CLUSTER_BY, "bisecting")[0].select("o_orderkey", "cluster")


@register("m21_cluster_profile", f"""SELECT o_orderpriority, round(avg(o_totalprice / {SCALE}), 6) AS target_mean, round(stddev_samp(o_totalprice / {SCALE}), 6) AS target_std,
  count(*) AS count, round(median(o_totalprice / {SCALE}), 6) AS target_median, round(avg(CAST(o_custkey AS DOUBLE)), 6) AS o_custkey_mean FROM orders GROUP BY 1""")
def m21(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.col("o_totalprice") / SCALE)
    return rounded(M.cluster_profile(o, "o_orderpriority", "y", ["o_custkey"]))


@register("m22_pca")
def m22(spark, sf):
    df, _ = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    proj, ratios = M.pca(df, ["qty", "disc", "tax", "c_acctbal"], 2)
    return rounded(proj.select("o_orderkey", F.col("pca")[0].alias("pc1"), F.col("pca")[1].alias("pc2")))


@register("m22_pca_variance")
def m22b(spark, sf):
    df, _ = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    ratios = M.pca(df, ["qty", "disc", "tax", "c_acctbal"], 2)[1]
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ratios)], "component int, explained_variance double"))


@register("m23_predict_clipped")
def m23(spark, sf):
    d, _ = prepared(spark, sf)
    m = M.fit_linear(d.where("is_train = 1"), "y")
    return rounded(M.predict_clipped(m, d.where("is_train = 0")).select("o_orderkey", "y", "prediction"))


@register("m24_subset_metrics", M9_SQL.replace("FROM labels WHERE quality IS NOT NULL",
                                               "FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars > 100"))
def m24(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.when(F.col("n_chars") > 100, F.col("n_chars")).alias("long_chars")), "doc_id")
    return rounded(M.subset_metrics(d, ["lang", "source", "long_chars"], "quality", "toxic"))


@register("m25_save_load_model")
def m25(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df, feats = M.prepare_matrix(model_table(spark, sf).drop("o_orderstatus"), "y", keep=["o_orderkey"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    base = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/models/linear_{zlib.crc32(sf.encode())}"
    M.save_model(pipe, path)
    return rounded(M.load_model(path).transform(df).select("o_orderkey", "y", "prediction"))


@register("m10_auc_ovr")
def m10b(spark, sf):
    """Macro one-vs-rest AUC of a balanced logistic model's class probabilities."""
    d, _ = cls_table(spark, sf)
    m = M.fit_classifier(d.where("is_train = 1"), "label", "logistic")
    pred = m.transform(d.where("is_train = 0"))
    classes = [float(r["label"]) for r in d.select("label").distinct().orderBy("label").collect()]
    return rounded(M.auc_ovr(pred, "label", "probability", classes))


@register("g10_score_horizons_model")
def g10m(spark, sf):
    """Last visit of every subject x 6 / 12 / 24 months ahead, scored by a
    progression model (linear regression of the score on time and the
    ordinal) fitted on all visits."""
    from pyspark.ml.feature import VectorAssembler
    from ..operators import longitudinal as G
    from ..operators import windows as W
    from .longitudinal import KEY, ORDER, visits
    v = visits(spark, sf)
    va = VectorAssembler(inputCols=["t_months", "ordinal"], outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol="score").fit(va.transform(v))
    grid = G.score_horizons(W.last_visit(v, KEY, ORDER), "t_months").withColumn("t_months", F.col("future_t"))
    scored = model.transform(va.transform(grid))
    return rounded(scored.select(KEY, "horizon_months", "future_t", F.col("prediction").alias("predicted_score")))
