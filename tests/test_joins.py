import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import joins as J
from tests.helpers import shuffle_partitions


def demo(seed, n_left=40, n_right=60):
    rng = np.random.default_rng(seed)
    left = pd.DataFrame({"lid": np.arange(n_left), "b": rng.integers(0, 2, n_left),
                         "v": np.round(rng.uniform(50, 70, n_left), 1)})
    right = pd.DataFrame({"rid": np.arange(100, 100 + n_right), "rb": rng.integers(0, 2, n_right),
                          "rv": np.round(rng.uniform(50, 70, n_right), 1)})
    return left, right


def brute_pairs(left, right, tol):
    m = left.merge(right, left_on="b", right_on="rb")
    m["diff"] = (m["v"] - m["rv"]).abs()
    return m[m["diff"] <= tol]


@pytest.mark.parametrize("seed", [0, 1])
def test_tolerance_join_matches_brute_force(spark, seed):
    left, right = demo(seed)
    got = J.tolerance_join(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")], "v", "rv", 2.0)
    got = sorted((r["lid"], r["rid"]) for r in got.collect())
    exp = sorted(zip(*[brute_pairs(left, right, 2.0)[c] for c in ("lid", "rid")]))
    assert got == exp


@pytest.mark.parametrize("seed,parts", [(0, 1), (1, 4), (2, 8)])
def test_nearest_match_matches_brute_force(spark, seed, parts):
    shuffle_partitions(spark, parts)
    left, right = demo(seed)
    got = J.nearest_match(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")],
                          "lid", "v", "rid", "rv", 2.0).toPandas()
    pairs = brute_pairs(left, right, 2.0).sort_values(["lid", "diff", "rid"])
    exp = pairs.groupby("lid").head(1)
    assert dict(zip(got["lid"], got["match_rid"])) == dict(zip(exp["lid"], exp["rid"]))


def sequential_greedy(left, right, tol):
    used, out = set(), {}
    for _, row in left.sort_values("lid").iterrows():
        c = right[(right["rb"] == row["b"]) & ((right["rv"] - row["v"]).abs() <= tol) & ~right["rid"].isin(used)]
        if len(c):
            d = (c["rv"] - row["v"]).abs()
            best = c.assign(d=d).sort_values(["d", "rid"]).iloc[0]["rid"]
            used.add(best)
            out[row["lid"]] = best
    return out


@pytest.mark.parametrize("seed", [0, 3, 5])
def test_greedy_match_equals_sequential(spark, seed):
    left, right = demo(seed, 60, 40)
    got = J.greedy_match(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")],
                         "lid", "lid", "v", "rid", "rv", 2.0).toPandas()
    assert got["match_rid"].is_unique
    assert dict(zip(got["lid"], got["match_rid"])) == sequential_greedy(left, right, 2.0)


def test_left_join_suffix(spark):
    l = spark.createDataFrame([(1, 10.0)], "k int, x double")
    r = spark.createDataFrame([(1, 20.0, "a")], "k int, x double, y string")
    out = J.left_join_suffixed(l, r, "k")
    assert out.columns == ["k", "x", "x_src", "y"]


def test_a_cluster_needs_a_shared_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace

    from strata.session import ensure_checkpoint_dir, is_local

    set_to = []
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=set_to.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
    session.conf.get = lambda key, default: "hdfs:///shared"
    assert ensure_checkpoint_dir(session) == "hdfs:///shared" and set_to == ["hdfs:///shared"]
    assert is_local("local") and is_local("local[8]") and not is_local("local-cluster[3,2,1024]") and not is_local("yarn")


def following_frames(plan: str) -> list[str]:
    """Window frames of a plan that are read anew for every row."""
    import re
    return [f for f in re.findall(r"specifiedwindowframe\(RowFrame, ([^)]*\)?, unboundedfollowing\$\(\))\)", plan) if not f.startswith("unboundedpreceding")]


def test_nearest_match_reads_no_frame_anew_for_every_row(spark, monkeypatch):
    """A frame from a row to the last one costs the square of the partition's rows."""
    plans = []
    monkeypatch.setattr(J, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df)
    left, right = demo(5)
    J.nearest_match(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")], "lid", "v", "rid", "rv", 2.0)
    assert any("windowspecdefinition" in p for p in plans)
    assert not [f for p in plans for f in following_frames(p)]


@pytest.mark.parametrize("pairs", [1, 7, 10_000])
def test_tolerance_join_cut_into_slices_matches_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(J, "TASK_PAIRS", pairs)
    left, right = demo(3)
    # rows that are equal but for the key, values that differ by the tolerance after rounding, gaps
    left = pd.concat([left, pd.DataFrame({"lid": [900, 901, 902, 903], "b": [0, 0, 1, 1], "v": [60.0, 60.0, 2.0, np.nan]})])
    right = pd.concat([right, pd.DataFrame({"rid": [900, 901, 902, 903], "rb": [0, 0, 1, 1], "rv": [60.0, 60.0, -1e-20, np.nan]})])
    got = J.tolerance_join(spark.createDataFrame(left), spark.createDataFrame(right), [("b", "rb")], "v", "rv", 2.0)
    assert got.columns == ["lid", "b", "v", "rid", "rb", "rv", "diff"]
    got = sorted((r["lid"], r["rid"], r["diff"]) for r in got.collect())
    assert got == sorted(brute_pairs(left, right, 2.0)[["lid", "rid", "diff"]].itertuples(index=False, name=None))
    assert (902, 902) in [g[:2] for g in got]


def test_tolerance_join_spreads_its_pairs_over_tasks(spark):
    """A few rows with very many pairs: no task is left with most of them."""
    left = spark.range(2000).coalesce(1).select(F.col("id").alias("lid"), F.lit(1).alias("b"), (F.col("id") % 7 / 10.0).alias("v"))
    right = spark.range(20_000).coalesce(1).select(F.col("id").alias("rid"), F.lit(1).alias("rb"), (F.col("id") % 11 / 10.0).alias("rv"))
    per = J.tolerance_join(left, right, [("b", "rb")], "v", "rv", 2.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per) == 40_000_000
    assert max(r["count"] for r in per) <= 20_000_000


def test_quick_round_equals_round(spark):
    from strata.catalog.registry import quick_round
    x = F.when(F.col("id") % 3 == 0, (F.col("id") - 50_000) / 2e6).when(F.col("id") % 3 == 1, F.randn(1) * 10).otherwise(F.randn(2) * 1e9)
    odd = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), -0.0, 1e-9, -1e-9, 0.0000005, -0.0000005, 1.0000005, 999.9999995)], "x double")
    for df in (spark.range(100_000).select(x.alias("x")), odd):
        assert df.select("x", F.round("x", 6).alias("a"), quick_round(F.col("x")).alias("b")).where("NOT (a <=> b)").isEmpty()
