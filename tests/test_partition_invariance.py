"""Results must not depend on partitioning: run partition-sensitive queries
(ranks, distributed row numbers, matching, quantiles, kNN) with 1 and with
8 shuffle partitions and compare the value digests."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
NAMES = ["w6_rank_pct", "l6_time_series_folds", "l5_split_stratified", "l7_sample_stratified", "j8_nearest_match",
         "j9_greedy_match", "t3_impute_knn", "g1_annualised_change", "d9_severe_decline", "m10_auc", "a4_median_per_key"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_8_partitions(spark, name):
    res = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            df = E.queries()[name](spark, SF)
            res.append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]
