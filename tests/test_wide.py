"""Profiles of a 163-column table, correlations over more than one tile."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.operators import agg as A
from strata.operators import quality as Q


def test_wide_tables(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 9, size=(60, 163)).astype(float), columns=[f"c{i}" for i in range(163)])
    pdf["c7"] = 1.0
    df = spark.createDataFrame(pdf)
    prof = {r["column"]: r for r in Q.profile_columns(df).collect()}
    assert {c: prof[c]["n_distinct"] for c in pdf} == pdf.nunique().to_dict()
    approx = {r["column"]: r["n_distinct"] for r in Q.profile_columns(df, approx_distinct=True).collect()}
    assert approx == pdf.nunique().to_dict()
    quality = {r["metric"]: r["value"] for r in Q.modelling_quality(df, "c0").collect()}
    assert quality["constant_features"] == 1 and quality["features"] == 162


def test_correlations_over_two_tiles(spark, monkeypatch):
    monkeypatch.setattr(A, "CORR_TILE", 40)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 9, size=(60, 11)).astype(float), columns=[f"c{i}" for i in range(11)])
    pdf["c7"] = 1.0
    got = A.corr_matrix(spark.createDataFrame(pdf), list(pdf)).toPandas().pivot(index="a", columns="b", values="corr").loc[list(pdf), list(pdf)]
    assert got.shape == (11, 11) and np.allclose(got.to_numpy(float), pdf.corr().to_numpy(), atol=1e-9, equal_nan=True)


def test_distinct_counts_read_a_wide_table_once(spark, tmp_path):
    """163 columns: one scan and one shuffle of rows for the distinct counts."""
    path = str(tmp_path / "wide")
    spark.createDataFrame(pd.DataFrame(np.arange(163 * 20).reshape(20, 163) % 7, columns=[f"c{i}" for i in range(163)])).write.parquet(path)
    df = spark.read.parquet(path)
    (row,) = S.distinct_counts(df, {c: c for c in df.columns})
    assert set(row.first().asDict().values()) == {7}
    plan = row._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert Q.profile_columns(df)._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 2


def test_distinct_counts_of_all_types(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (1Y, true, 0.0D, float('nan'), 1.10BD, 'a', date'2020-01-01', timestamp'2020-01-01 00:00:00', x'00ff', array(1), timestamp_ntz'2020-03-01 01:00:00', CAST(NULL AS string)),
      (2Y, true, -0.0D, float('nan'), 1.1BD, '', date'2020-01-01', timestamp'2020-01-01 00:00:00.000001', x'00fe', array(1), timestamp_ntz'2020-03-01 01:00:00', NULL),
      (NULL, NULL, double('nan'), NULL, 1.11BD, 'A', NULL, NULL, x'', array(2), NULL, NULL)
      AS t(b, o, d, f, m, s, dt, ts, x, arr, nt, nothing)""")
    frames = S.distinct_counts(df, {c: c for c in df.columns})
    got = {k: v for f in frames for k, v in f.first().asDict().items()}
    assert got == {"b": 2, "o": 1, "d": 2, "f": 1, "m": 2, "s": 3, "dt": 1, "ts": 2, "x": 3, "arr": 2, "nt": 1, "nothing": 0}
    assert got == df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    empty = {k: v for f in S.distinct_counts(df.limit(0), {c: c for c in df.columns}) for k, v in f.first().asDict().items()}
    assert set(empty.values()) == {0}
