"""Model training and evaluation on Spark ML.

Estimators are Spark ML's distributed implementations.  Metrics are plain
aggregates over a prediction table, so they are exact and can be checked
with SQL.  Folds, splits and bootstrap samples are keyed by hashes of a row
key (deterministic, partition-independent).  Iterative loops (folds,
stacking) cut lineage into the checkpoint folder between rounds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import clip, finite
from ..functions.stats import fit_stats, group_quantiles, lit_or_null, rank_pct, same_keys
from ..session import cut_lineage
from .bisecting import fit_bisecting
from .kmeans import fit_kmeans
from .penalised import Penalty, fit_penalised
from .scale import label_encode, scale_standard
from .select import NUMERIC, hash_unit
from .support import Support, fit_support, held_out_errors
from .trees import Boost, blocks_of, boost, fit_bins, forest_errors
from .ward import fit_ward, ward_silhouettes
from .windows import subject_window


#: fits that may run at the same time
SIDE_BY_SIDE = 4

#: classes whose weights go to every task
FEW_CLASSES = 10_000


def side_by_side(spark, fits: Sequence, run) -> list:
    """``run(x)`` for every x, a few at a time: small fits leave most of a
    cluster idle between their jobs.  Results are in the order of ``fits``, and
    the first error is raised."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), fits))


# -- M1 ---------------------------------------------------------------------------

def prepare_matrix(df: DataFrame, target: str, exclude: Sequence[str] = (), max_missing: float = 0.5,
                   lo_q: float = 0.05, hi_q: float = 0.95, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """M1: rows with a target; leakage / excluded columns dropped; text
    columns label-encoded; numbers as double with +/-inf -> null; columns
    more than ``max_missing`` missing dropped; median fill; clip to the
    5th / 95th percentile.  Returns the table (``keep`` + target + features)
    and the feature names."""
    base = df.where(F.col(target).isNotNull()).drop(*[c for c in exclude if c in df.columns])
    feats = [c for c in base.columns if c != target and c not in keep]
    for c in feats:
        if not isinstance(base.schema[c].dataType, NUMERIC):
            base = label_encode(base, c, f"_enc_{c}").drop(c).withColumnRenamed(f"_enc_{c}", c)
    base = base.select(*keep, target, *[finite(F.col(c).cast("double")).alias(c) for c in feats])
    shares = base.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in feats]).first()
    feats = [c for c in feats if shares[c] <= max_missing]
    st = fit_stats(base, {c: ["median", f"q{lo_q}", f"q{hi_q}"] for c in feats})
    cols = [clip(F.coalesce(F.col(c), lit_or_null(st[(c, "median")])), st[(c, f"q{lo_q}")], st[(c, f"q{hi_q}")]).alias(c)
            for c in feats]
    return base.select(*keep, target, *cols), feats


def assemble(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep").transform(df)


# -- estimators (M2-M4, M14, M18-M20, M22) -------------------------------------------

def fit_linear(df: DataFrame, label: str, l1: float = 0.0, l2: float = 0.0, features: str = "features"):
    """M2: OLS / ridge / lasso / elastic net (Spark's penalty scaling)."""
    reg = l1 + l2
    enet = 0.0 if reg == 0 else l1 / reg
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=enet).fit(df)


def tree_regressor(kind: str, label: str, features: str = "features", seed: int = 42):
    """M3 settings of the reference: forest 100 trees depth 8 min leaf 5;
    boosted 100 rounds depth 6 step 0.1."""
    if kind == "rf":
        return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=100, maxDepth=8,
                                     minInstancesPerNode=5, seed=seed)
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=100, maxDepth=6, stepSize=0.1, seed=seed)


def fit_trees_reg(df: DataFrame, label: str, kind: str = "rf", features: str = "features"):
    """M3: random forest or boosted-tree regression."""
    return tree_regressor(kind, label, features).fit(df)


def fit_second_order(df: DataFrame, label: str, key: str, feats: Sequence[str], rounds: int = 100, depth: int = 6, rate: float = 0.1,
                     l2: float = 1.0, gamma: float = 0.0, bins: int = 64):
    """M3: second-order boosted regression on columns that may hold nulls:
    L2-regularised leaves and gains, and for every split a learnt direction
    for missing values (``trees.boost``)."""
    edges = fit_bins(df, feats, bins)
    return boost(blocks_of(df, edges, label, key), edges, [Boost(depth, rate, l2, gamma)], rounds)[0][0]


def fit_support_reg(df: DataFrame, label: str, C: float = 1.0, epsilon: float = 0.1, features: str = "features"):  # noqa: N803
    """M6: linear support-vector regression (``support.fit_support``); rows
    without a label are left out."""
    return fit_support(df, label, [Support(C, epsilon)], features)[0]


def class_weights(df: DataFrame, y: str, out: str = "class_weight", manual: Mapping | None = None) -> DataFrame:
    """M5: balanced weight n / (k * n_c) per row (aggregate + join), or a
    manual class -> weight map."""
    if manual is not None:
        kv = [x for k, v in manual.items() for x in (F.lit(k), F.lit(float(v)))]
        return df.withColumn(out, F.element_at(F.create_map(*kv), F.col(y)))
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = counts.select(y, (F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("_nc"))).alias(out))
    # a shuffle by class would leave the rows in as many tasks as there are classes
    return df.join(F.broadcast(w) if tot["k"] <= FEW_CLASSES else w, y, "left")


def fit_classifier(df: DataFrame, label: str, kind: str = "logistic", features: str = "features", seed: int = 42):
    """M4: logistic regression, random forest and linear SVM with balanced
    class weights, and boosted trees; SVM and boosted trees are one-vs-rest
    for more than two classes."""
    w = class_weights(df, label, "_w")
    common = {"featuresCol": features, "labelCol": label}
    if kind == "logistic":
        return LogisticRegression(**common, weightCol="_w", maxIter=500).fit(w)
    if kind == "rf":
        return RandomForestClassifier(**common, weightCol="_w", numTrees=100, maxDepth=10, seed=seed).fit(w)
    if kind == "gbt":
        base = GBTClassifier(**common, maxIter=100, maxDepth=4, subsamplingRate=0.5, seed=seed)
        return base.fit(df) if _n_classes(df, label) <= 2 else OneVsRest(classifier=base, **common).fit(df)
    if kind == "svm":
        base = LinearSVC(**common, weightCol="_w", maxIter=500)
        return base.fit(w) if _n_classes(df, label) <= 2 else OneVsRest(classifier=base, weightCol="_w", parallelism=SIDE_BY_SIDE, **common).fit(w)
    raise ValueError(kind)


def _n_classes(df: DataFrame, label: str) -> int:
    """2 if the labels are 0 and 1 at most, else more."""
    return 2 if df.where(~F.col(label).isin(0, 1)).isEmpty() else 3


# FIXED VALUES: the values each kind of model is searched over.
GRIDS = {
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "elastic_net": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, None], "min_samples_split": [2, 5]},
    "linear_svr": {"C": [0.1, 1.0, 10.0]},
    "gradient_boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
}


def penalised(label: str, l1: float, l2: float, sd: float, features: str = "features") -> LinearRegression:
    """Least squares on the mean of half the squares plus l1 |w| and
    l2 / 2 |w|^2.  Spark fits the label divided by its standard deviation
    ``sd`` (population), which leaves l1 as it is and divides l2 by it."""
    reg = l1 + l2 * sd
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, standardization=False)


def size_and_sd(df: DataFrame, label: str) -> tuple[int, float]:
    row = df.agg(F.count(label), F.stddev_pop(label)).first()
    return row[0], row[1] or 1.0


def grid_penalties(kind: str, params: Mapping, n: float) -> tuple[float, float]:
    """(l1, l2) of one grid point, for ``n`` rows (a ridge penalty alpha on the
    sum of squares is alpha / n on their mean)."""
    if kind == "ridge":
        return 0.0, params["alpha"] / n
    if kind == "lasso":
        return params["alpha"], 0.0
    if kind == "elastic_net":
        return params["alpha"] * params["l1_ratio"], params["alpha"] * (1 - params["l1_ratio"])
    raise ValueError(kind)


def grid_estimator(kind: str, params: Mapping, label: str, n: float, sd: float, features: str = "features"):
    """The linear estimator of one grid point, for ``n`` rows and a label with
    standard deviation ``sd``."""
    return penalised(label, *grid_penalties(kind, params, n), sd, features)


def grid_search(df: DataFrame, label: str, key, kinds: Sequence[str] = tuple(GRIDS), k: int = 5,
                grids: Mapping[str, Mapping] = GRIDS, features: str | Sequence[str] = "features") -> DataFrame:
    """M6: k-fold grid search over the regularisation, support-vector, forest
    and boosting parameters: one row per kind and grid point with its parameters (JSON),
    mean RMSE over the folds and whether it is the best of its kind.  Folds
    come from the key's hash; the folded matrix is written once.

    ``features`` is a vector column, or, for forests and boosting alone, the
    names of the feature columns.  Those kinds are staged (``trees``): one
    forest per fold, grown to the end, holds all its grid points, and all
    boosted models grow side by side, with the scores of fewer rounds read on
    the way."""
    spark = df.sparkSession
    f = cut_lineage(fold_column(df, key, k))
    rows = []
    for kind in kinds:
        points = [dict(zip(grids[kind], values)) for values in product(*grids[kind].values())]
        score = {"random_forest": _forest_grid, "gradient_boosting": _boosting_grid,
                 "linear_svr": _support_grid}.get(kind, _linear_grid)
        found = score(kind, f, label, key, points, k, features)
        means = [sum(e) / len(e) if (e := [x for x in errors if x is not None]) else None for errors in found]
        low = min((m for m in means if m is not None), default=None)
        best = next((j for j, m in enumerate(means) if m == low), None)
        rows += [(kind, json.dumps(p), m, int(j == best)) for j, (p, m) in enumerate(zip(points, means))]
    return spark.createDataFrame(rows, "model string, params string, cv_rmse double, best int")


def _linear_grid(kind: str, f: DataFrame, label: str, key, points: list, k: int, features: str) -> list[list]:
    """All points and folds from the same sums of products (``penalised``);
    the penalties are those of ``grid_estimator``."""
    n, sd = size_and_sd(f, label)
    if not n:
        return [[None] * k for _ in points]
    each = [grid_penalties(kind, p, n * (k - 1) / k) for p in points]
    models = [Penalty(l1, l2 * sd, fold=i) for l1, l2 in each for i in range(k)]
    errors = held_out_errors(f, fit_penalised(f, label, models, features, "fold"), models, label, features, "fold")
    return [errors[j * k:(j + 1) * k] for j in range(len(points))]


def _feature_columns(f: DataFrame, features: str | Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The features as columns; a vector column is taken apart."""
    if not isinstance(features, str):
        return f, list(features)
    first = f.select(features).first()
    names = [f"_f{i}" for i in range(len(first[0]) if first else 0)]
    return f.select("*", *[vector_to_array(F.col(features))[i].alias(n) for i, n in enumerate(names)]), names


def _forest_grid(kind: str, f: DataFrame, label: str, key, points: list, k: int, features: str | Sequence[str]) -> list[list]:
    f, features = _feature_columns(f, features)
    bins = fit_bins(f, features)
    axis = lambda name: list(dict.fromkeys(p[name] for p in points))
    got = forest_errors(blocks_of(f, bins, label, key, "fold"), bins, k, axis("n_estimators"), axis("max_depth"), axis("min_samples_split"))
    return [got[p["n_estimators"], p["max_depth"], p["min_samples_split"]] for p in points]


def _boosting_grid(kind: str, f: DataFrame, label: str, key, points: list, k: int, features: str | Sequence[str]) -> list[list]:
    f, features = _feature_columns(f, features)
    bins = fit_bins(f, features)
    marks = sorted({p["n_estimators"] for p in points})
    each = list(dict.fromkeys((p["learning_rate"], p["max_depth"]) for p in points))
    models = [Boost(depth, rate, l2=0.0, fold=i) for rate, depth in each for i in range(k)]
    _, scores = boost(blocks_of(f, bins, label, key, "fold"), bins, models, marks[-1], marks)
    rmse = {at: math.sqrt(e / n) if n else None for at, (e, n) in scores.items()}
    return [[rmse[each.index((p["learning_rate"], p["max_depth"])) * k + i, p["n_estimators"]] for i in range(k)] for p in points]


def _support_grid(kind: str, f: DataFrame, label: str, key, points: list, k: int, features: str) -> list[list]:
    """All points and folds advance side by side."""
    models = [Support(p["C"], p.get("epsilon", 0.1), fold=i) for p in points for i in range(k)]
    errors = held_out_errors(f, fit_support(f, label, models, features, "fold"), models, label, features, "fold")
    return [errors[j * k:(j + 1) * k] for j in range(len(points))]


def fold_column(df: DataFrame, key, k: int, label: str | None = None, seed: int = 42, out: str = "fold") -> DataFrame:
    """Deterministic fold ids: hash of the key mod k, or (stratified) the
    rank inside the class in hash order mod k."""
    if label is None:
        return df.withColumn(out, F.pmod(hash_unit(key, seed), F.lit(k)).cast("int"))
    from ..functions.stats import global_row_number
    keys = [key] if isinstance(key, str) else list(key)
    h = df.withColumn("_h", hash_unit(keys, seed))
    return global_row_number(h, [label], ["_h", *keys], "_rn").withColumn(out, (F.col("_rn") % k).cast("int")).drop("_h", "_rn")


def cross_validate(df: DataFrame, est, label: str, key, k: int = 5, metric: str = "rmse",
                   stratify: bool = False, prediction: str = "prediction") -> DataFrame:
    """M7: k-fold scores: one row per fold plus mean / std rows (RMSE for
    regression, weighted F1 for classification)."""
    f = cut_lineage(fold_column(df, key, k, label if stratify else None))
    spark = df.sparkSession

    def score(i: int) -> tuple[int, float]:
        model = est.copy().fit(f.where(F.col("fold") != i))
        pred = model.transform(f.where(F.col("fold") == i))
        if metric == "rmse":
            v = regression_metrics(pred, label, prediction).where(F.col("metric") == "rmse").first()["value"]
        else:
            v = classification_metrics(pred, label, prediction).where(F.col("metric") == "f1_weighted").first()["value"]
        return i, float(v)

    rows = side_by_side(spark, list(range(k)), score)
    scores = spark.createDataFrame(rows, "fold int, score double")
    mean = sum(r[1] for r in rows) / k
    std = math.sqrt(sum((r[1] - mean) ** 2 for r in rows) / (k - 1)) if k > 1 else 0.0
    return scores.unionByName(spark.createDataFrame([(-1, mean), (-2, std)], "fold int, score double"))


# -- metrics (M8-M11, M24) ----------------------------------------------------------

def _long(row: DataFrame, names: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M8: RMSE, MAE and R2 = 1 - SSE / SST in one aggregate."""
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    row = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
        F.var_pop(F.col(y).cast("double")).alias("_vp"), F.count(F.lit(1)).alias("_n"))
    row = row.withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_vp") * F.col("_n")))
    return _long(row, ["rmse", "mae", "r2"])


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """M9: accuracy, weighted precision / recall / F1, macro F1 and per-class
    recall from the confusion counts (zero divisions -> 0)."""
    c = confusion(df.where(F.col(y).isNotNull()), y, yhat)
    tp = c.where(F.col("y") == F.col("yhat")).groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("tp"))
    sup = c.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    pp = c.groupBy(F.col("yhat").alias("cls")).agg(F.sum("n").alias("pred"))
    per = (sup.join(pp, "cls", "full").join(tp, "cls", "left")
           .select("cls", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("support", "pred", "tp")]))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    per = per.select("cls", "support", "tp", prec.alias("p"), rec.alias("r"), f1.alias("f1"))
    n = F.sum("support")
    agg = per.agg((F.sum("tp") / n).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / n).alias("precision_weighted"),
                  (F.sum(F.col("r") * F.col("support")) / n).alias("recall_weighted"),
                  (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
                  F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("f1_macro"))
    overall = _long(agg, ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro"])
    per_class = per.where(F.col("support") > 0).select(F.concat(F.lit("recall_class_"), F.col("cls").cast("string")).alias("metric"),
                                                       F.col("r").cast("double").alias("value"))
    return overall.unionByName(per_class)


def auc(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """M10 (binary): rank-sum AUC with average ranks for ties:
    (sum of positive ranks - n1 (n1 + 1) / 2) / (n1 n0)."""
    d = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select((F.col(y) == positive).cast("int").alias("_pos"),
                                                                          F.col(score).cast("double").alias("_s"))
    r = rank_pct(d, "_s", "_pct")
    n = d.count()
    a = r.agg(F.sum(F.when(F.col("_pos") == 1, F.col("_pct") * n)).alias("_rs"), F.sum("_pos").alias("_n1"),
              F.count(F.lit(1)).alias("_n"))
    return a.select(((F.col("_rs") - F.col("_n1") * (F.col("_n1") + 1) / 2) / (F.col("_n1") * (F.col("_n") - F.col("_n1")))).alias("auc"))


def auc_ovr(df: DataFrame, y: str, proba: str, classes: Sequence) -> DataFrame:
    """M10 (multi-class): macro mean of one-vs-rest AUCs on the probability
    vector column."""
    arr = vector_to_array(F.col(proba)) if not isinstance(df.schema[proba].dataType, T.ArrayType) else F.col(proba)
    d = df.withColumn("_p", arr)
    vals = [auc(d.withColumn("_sc", F.col("_p")[i]), y, "_sc", c).first()["auc"] for i, c in enumerate(classes)]
    vals = [v for v in vals if v is not None]
    return df.sparkSession.createDataFrame([(sum(vals) / len(vals) if vals else None,)], "auc_macro double")


def compare_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Per model R2 / RMSE / MAE (wide) with the weighted score
    0.4 R2 + 0.3 (1 - RMSE / max RMSE) + 0.3 (1 - MAE / max MAE) and a rank."""
    w = Window.partitionBy()
    s = metrics.select(model, "r2", "rmse", "mae",
                       (0.4 * F.col("r2") + 0.3 * (1 - F.col("rmse") / F.max("rmse").over(w))
                        + 0.3 * (1 - F.col("mae") / F.max("mae").over(w))).alias("weighted_score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weighted_score"), model)))


def subset_metrics(df: DataFrame, required: Sequence[str], y: str, yhat: str) -> DataFrame:
    """Classification metrics on rows where every required marker is present."""
    d = df
    for c in required:
        d = d.where(F.col(c).isNotNull())
    return classification_metrics(d, y, yhat)


# -- model outputs -----------------------------------------------------------------

def importance(spark, model, feats: Sequence[str], n: int = 20) -> DataFrame:
    """Feature importances (trees) or |coefficients| (linear), top n."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    df = spark.createDataFrame(list(zip(feats, [float(v) for v in vals])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def vote(df: DataFrame, preds: Sequence[str], how: str = "mean", out: str = "vote") -> DataFrame:
    """Mean of predictions (regression / soft probabilities) or the
    majority label (ties -> smallest label)."""
    if how == "mean":
        return df.withColumn(out, sum((F.col(p).cast("double") for p in preds), F.lit(0.0)) / len(preds))
    arr = F.array(*[F.col(p) for p in preds])
    scored = F.transform(arr, lambda x: F.struct(F.size(F.filter(arr, lambda y: y == x)).alias("n"), (-x).alias("neg"), x.alias("v")))
    return df.withColumn(out, F.array_max(scored)["v"])


def fit_bagging(df: DataFrame, label: str, n: int = 10, classify: bool = False, features: str = "features", seed: int = 42):
    """Bagging of n full-feature trees on bootstrap samples (a forest
    with every feature considered at every split)."""
    cls = RandomForestClassifier if classify else RandomForestRegressor
    return cls(featuresCol=features, labelCol=label, numTrees=n, featureSubsetStrategy="all", bootstrap=True,
               subsamplingRate=1.0, seed=seed).fit(df)


class Stacking:
    """M15, fitted: base models on all rows and the model on top of their
    predictions."""

    def __init__(self, oof: DataFrame, bases: Mapping[str, object], meta):
        self.oof, self.bases, self.meta = oof, dict(bases), meta

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` plus ``pred_<base>`` of every base model and the stacked
        prediction."""
        names = list(df.columns)
        for name, m in self.bases.items():
            df = m.transform(df).select(*names, F.col("prediction").alias(f"pred_{name}"))
            names.append(f"pred_{name}")
        done = self.meta.transform(assemble(df, [f"pred_{n}" for n in self.bases], "_meta"))
        return done.select(*names, F.col("prediction").alias(out))


def stacking_bases(label: str, task: str, n: int, sd: float, features: str = "features") -> dict:
    """Level-0 models: forest of 50 trees and ridge (alpha 1) or logistic
    regression (C = 1); kernel machines are not built."""
    common = {"featuresCol": features, "labelCol": label}
    if task == "regression":
        return {"rf": RandomForestRegressor(**common, numTrees=50, seed=42), "ridge": penalised(label, 0.0, 1.0 / n, sd, features)}
    return {"rf": RandomForestClassifier(**common, numTrees=50, seed=42), "lr": LogisticRegression(**common, regParam=1.0 / n, standardization=False, maxIter=1000)}


def fit_stacking(df: DataFrame, label: str, key: str, bases: Mapping[str, object] | None = None, k: int = 5,
                 features: str = "features", task: str = "regression") -> Stacking:
    """Out-of-fold predictions of every base model (k folds by key hash)
    train the model on top, ridge with alpha 0.1 or logistic regression; the
    base models are fitted anew on all rows, all of them a few at a time.  The
    folded matrix is written once; ``oof`` of the result holds the out-of-fold predictions."""
    f = cut_lineage(fold_column(df, key, k))
    n, sd = size_and_sd(f, label)
    bases = dict(bases or stacking_bases(label, task, n, sd, features))
    each = [(name, i) for name in bases for i in (None, *range(k))]
    models = dict(zip(each, side_by_side(df.sparkSession, each, lambda one: bases[one[0]].copy().fit(
        f if one[1] is None else f.where(F.col("fold") != one[1])))))
    oof = f.select(key, label)
    for name in bases:
        parts = [models[name, i].transform(f.where(F.col("fold") == i)).select(key, F.col("prediction").alias(f"pred_{name}")) for i in range(k)]
        oof = oof.join(cut_lineage(reduce(DataFrame.unionByName, parts)), key)
    meta_in = assemble(oof, [f"pred_{name}" for name in bases], "_meta")
    meta = (penalised(label, 0.0, 0.1 / n, sd, "_meta") if task == "regression"
            else LogisticRegression(featuresCol="_meta", labelCol=label, regParam=1.0 / n, standardization=False, maxIter=1000))
    return Stacking(oof, {name: models[name, None] for name in bases}, meta.fit(meta_in))


def fit_experts(df: DataFrame, label: str, groups: Mapping[str, Sequence[str]], key: str, task: str = "regression") -> DataFrame:
    """One forest of 100 trees per modality group; its predictions become
    fusion feature columns ``expert_<group>``."""
    forest = RandomForestRegressor if task == "regression" else RandomForestClassifier
    out = df
    for g, cols in groups.items():
        a = assemble(df, cols, "_gf")
        m = forest(featuresCol="_gf", labelCol=label, numTrees=100, seed=42).fit(a)
        out = out.join(m.transform(a).select(key, F.col("prediction").alias(f"expert_{g}")), key)
    return out


def progression_features(df: DataFrame, key: str, order, t: str, y: str) -> DataFrame:
    """Rows of subjects with at least two visits, plus change_from_baseline,
    rate_of_change (per time since the visit before; null without time
    between), overall_slope (least squares over the subject's visits; null
    for two, 0 where a time or value is missing or time stands still),
    max_value, min_value and variability (sample standard deviation)."""
    w, wall = subject_window(key, order), Window.partitionBy(key)
    yv, tv = F.col(y).cast("double"), F.col(t).cast("double")
    n = F.count(F.lit(1)).over(wall)
    whole = (F.count(yv).over(wall) == n) & (F.count(tv).over(wall) == n)
    slope = F.try_divide(F.covar_pop(tv, yv).over(wall), F.var_pop(tv).over(wall))
    return (df.withColumn("_n", n)
            .withColumn("change_from_baseline", yv - F.first(yv).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("rate_of_change", F.try_divide(yv - F.lag(yv).over(w), tv - F.lag(tv).over(w)))
            .withColumn("overall_slope", F.when(n >= 3, F.when(whole, F.coalesce(slope, F.lit(0.0))).otherwise(0.0)))
            .withColumn("max_value", F.max(yv).over(wall)).withColumn("min_value", F.min(yv).over(wall))
            .withColumn("variability", F.stddev_samp(yv).over(wall))
            .where(F.col("_n") >= 2).drop("_n"))


def fit_progression(df: DataFrame, label: str, feats: Sequence[str], key: str) -> DataFrame:
    """Linear model and forest (100 trees, depth 10) on
    ``progression_features`` and time, missing values filled with medians;
    returns M8 metrics per model on a hash-split hold-out."""
    from .select import split_random
    st = fit_stats(df, {c: ["median"] for c in [*feats, label]})
    full = [c for c in feats if st[(c, "median")] is not None]
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), lit_or_null(st[(c, "median")])).alias(c) for c in [*full, label]])
    a = cut_lineage(assemble(split_random(filled, key), full))
    train, test = a.where("is_train = 1"), a.where("is_train = 0")
    res = []
    for name, est in (("linear_regression", LinearRegression(featuresCol="features", labelCol=label)),
                      ("random_forest", RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=100, maxDepth=10, seed=42))):
        pred = est.fit(train).transform(test)
        res.append(regression_metrics(pred, label, "prediction").withColumn("model", F.lit(name)))
    return res[0].unionByName(res[1])


def _best(rows: list[tuple], at: int, pick) -> int | None:
    """k of the best scored row (the first of equal ones)."""
    scored = [r for r in rows if r[at] is not None]
    return pick(scored, key=lambda r: r[at])[0] if scored else None


def cluster_auto(df: DataFrame, feats: Sequence[str], method: str = "kmeans", ks: Sequence[int] = range(2, 8),
                 seed: int = 42) -> tuple[DataFrame, DataFrame, object]:
    """Cluster with the best k.  k-means (best of 10 starts by cost,
    all starts and k advance side by side, see ``kmeans``), Ward's agglomerative clustering (``ward``, one tree for every k) and
    bisecting k-means (``bisecting``, each division made once for all k) take the k with the largest silhouette (squared
    Euclidean), Gaussian mixtures the one with the smallest BIC
    p ln n - 2 log L, p = k (d + d (d + 1) / 2) + k - 1.

    Returns the rows of ``df`` without gaps in ``feats`` plus ``cluster``, the
    scan (one row per k, ``best`` marked) and the fitted model, whose
    ``transform`` assigns new rows.  The assembled matrix is written once."""
    a = cut_lineage(assemble(df.dropna(subset=list(feats)), feats))
    n, d, rows, models = a.count(), len(feats), [], {}
    if method == "ward":
        tree = fit_ward(a)
        a = cut_lineage(tree.assign(a))
        wards = {k: tree.at(k) for k in ks}
        scores = dict(zip(ks, ward_silhouettes(a, list(wards.values()))))
    elif method == "bisecting":
        fitted = dict(zip(ks, fit_bisecting(a, list(ks), seed=seed)))
    elif method == "kmeans":
        fitted = dict(zip(ks, fit_kmeans(a, list(ks), 10, seed=seed)))
    for k in ks:
        if method == "gmm":
            m = GaussianMixture(k=k, seed=seed).fit(a)
            ll = float(m.summary.logLikelihood)
            p = k * (d + d * (d + 1) / 2) + k - 1
            rows.append((int(k), ll, p * math.log(n) - 2 * ll))
        elif method == "kmeans":
            m, cost, score = fitted[k]
            rows.append((int(k), score, cost))
        elif method == "ward":
            m = wards[k]
            rows.append((int(k), scores[k]))
        else:
            m, score = fitted[k]
            rows.append((int(k), score))
        models[int(k)] = m
    names = {"gmm": "k int, log_likelihood double, bic double", "kmeans": "k int, silhouette double, cost double"}.get(method, "k int, silhouette double")
    best = _best(rows, 2, min) if method == "gmm" else _best(rows, 1, max)
    scan = df.sparkSession.createDataFrame([(*r, int(r[0] == best)) for r in rows], names + ", best int")
    chosen = models[best if best is not None else int(list(ks)[0])]
    return chosen.transform(a).select(*df.columns, F.col("prediction").alias("cluster")), scan, chosen


def cluster_profile(df: DataFrame, cluster: str, y: str, feats: Sequence[str]) -> DataFrame:
    """Per cluster target mean / std / count / median and feature means."""
    t = F.col(y).cast("double")
    g = df.groupBy(cluster).agg(F.avg(t).alias("target_mean"), F.stddev_samp(t).alias("target_std"),
                                F.count(t).alias("count"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in feats])
    med = group_quantiles(df, [cluster], y, [0.5], ["target_median"])
    return same_keys(g, med, [cluster]).select(cluster, "target_mean", "target_std", "count", "target_median",
                                                 *[f"{c}_mean" for c in feats])


def pca(df: DataFrame, feats: Sequence[str], k: int = 2):
    """PCA on population-standardised columns; returns the projected
    table and the explained-variance ratios."""
    s = scale_standard(df, feats, suffix="_std")
    a = assemble(s, [f"{c}_std" for c in feats], "_z")
    m = PCA(k=k, inputCol="_z", outputCol="pca").fit(a)
    return m.transform(a).withColumn("pca", vector_to_array("pca")), list(m.explainedVariance.toArray())


def predict_clipped(model, df: DataFrame, lo: float = 0.0, hi: float = 1.0, col: str = "prediction") -> DataFrame:
    """Model predictions clipped to [lo, hi]."""
    return model.transform(df).withColumn(col, clip(col, lo, hi))


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline / model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a persisted pipeline."""
    return PipelineModel.load(path)
