import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions import nulls as N
from strata.functions import stats as S
from tests.helpers import shuffle_partitions


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (10.0,), (None,)], "x double")
    got = [r[0] for r in df.select(N.flag(F.col("x") < 5)).collect()]
    assert got == [1, 0, 0, 0]


def test_bin_right_closed_matches_pandas(spark):
    vals = [0.0, .33, .330001, .66, 1.0, 1.01, -0.1, None]
    edges, labels = [0, .33, .66, 1], ["a", "b", "c"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    for lowest in (False, True):
        got = [r[0] for r in df.orderBy("i").select(N.bin_right_closed("x", edges, labels, lowest)).collect()]
        exp = pd.cut(pd.Series(vals, dtype=float), edges, labels=labels, include_lowest=lowest)
        assert got == [None if pd.isna(v) else v for v in exp]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (99.0,)], "x double")
    assert [r[0] for r in df.select(N.clip("x", 2, 50)).collect()] == [2.0, None, 50.0]


def test_corrected_skew_kurt_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    st = S.fit_stats(df, {"x": ["skew", "kurt", "median", "p25", "std", "std_pop"]})
    s = pd.Series(vals)
    assert st[("x", "skew")] == pytest.approx(s.skew(), rel=1e-9)
    assert st[("x", "kurt")] == pytest.approx(s.kurt(), rel=1e-9)
    assert st[("x", "median")] == pytest.approx(s.median())
    assert st[("x", "p25")] == pytest.approx(s.quantile(0.25))
    assert st[("x", "std")] == pytest.approx(s.std())
    assert st[("x", "std_pop")] == pytest.approx(s.std(ddof=0))


def test_constant_column_skew_zero(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert S.fit_stats(df, {"x": ["skew"]})[("x", "skew")] == 0.0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_rank_pct_average_ties(spark, parts):
    shuffle_partitions(spark, parts)
    vals = [1.0, 2.0, 2.0, 4.0, 9.0, None, 2.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r["i"]: r["p"] for r in S.rank_pct(df, "x", "p").collect()}
    exp = pd.Series(vals, dtype=float).rank(pct=True)
    for i, e in enumerate(exp):
        assert (got[i] is None and pd.isna(e)) or got[i] == pytest.approx(e)


def test_global_row_number_matches_window(spark):
    shuffle_partitions(spark, 7)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "t": rng.integers(0, 50, 500).astype(float), "k": np.arange(500)})
    df = spark.createDataFrame(pdf)
    got = S.global_row_number(df, ["g"], ["t", "k"], "rn").toPandas().sort_values("k")
    exp = pdf.sort_values(["g", "t", "k"]).assign(rn=lambda d: d.groupby("g").cumcount() + 1).sort_values("k")
    assert got["rn"].tolist() == exp["rn"].tolist()


def tail_by_quadrature(t: float, dof: float) -> float:
    """Two-sided Student-t tail: Simpson's rule over the angle atan(t / sqrt(dof))."""
    from math import atan, exp, lgamma, pi, sqrt
    th = np.linspace(atan(abs(t) / sqrt(dof)), pi / 2, 200001)
    y = np.abs(np.cos(th)) ** (dof - 1)
    area = (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum()) * (th[1] - th[0]) / 3
    return 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi) * float(area)


def test_t_pvalue_is_the_tail_integral(spark):
    # two-sided Student-t tails: t=2.228 with 10 dof is the 5 % point; t=0 gives 1
    pairs = [(2.228138852, 10.0), (0.0, 5.0), (1.959963985, 1e7), (-2.228138852, 10.0)]
    pairs += [(t, d) for t in (0.01, 0.7, 1.5, 1.75, 4.0, 12.0) for d in (1.0, 2.0, 3.0, 7.5, 48.0, 333.3, 20000.0)]
    odd = [(None, 3.0), (1.0, None), (float("nan"), 3.0), (float("inf"), 3.0), (1.0, float("nan")), (1.0, 0.0), (1.0, -2.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs + odd)], "i int, t double, d double")
    got = [r["p"] for r in df.select("i", S.t_pvalue("t", "d").alias("p")).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-9) and got[1] == 1.0 and got[2] == pytest.approx(0.05, abs=1e-7) and got[3] == got[0]
    for (t, d), p in zip(pairs[4:], got[4:]):
        assert p == pytest.approx(tail_by_quadrature(t, d), abs=1e-8), (t, d)
    assert got[len(pairs):] == [None] * len(odd)


def test_row_stats_match_pandas(spark):
    rows = [(1.0, None, 3.0), (None, None, None), (2.0, 2.0, 2.0), (5.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(N.row_mean(["a", "b", "c"]).alias("m"), N.row_std(["a", "b", "c"]).alias("s")).collect()
    pdf = pd.DataFrame(rows, columns=list("abc"))
    for r, (m, s) in zip(got, zip(pdf.mean(axis=1), pdf.std(axis=1))):
        assert (r["m"] is None and pd.isna(m)) or r["m"] == pytest.approx(m)
        assert (r["s"] is None and pd.isna(s)) or r["s"] == pytest.approx(s)


def test_global_row_number_spreads_one_date(spark):
    """Half of the rows share the first order column and one group."""
    shuffle_partitions(spark, 8)
    pdf = pd.DataFrame({"g": ["a"] * 900 + [None] * 100, "d": [1] * 500 + list(range(500)), "k": np.arange(1000)[::-1]})
    df = spark.createDataFrame(pdf)
    got = S.global_row_number(df, ["g"], ["d", "k"], "rn")
    assert max(r["count"] for r in got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()) < 500
    got = got.toPandas().sort_values("k")
    exp = pdf.sort_values(["d", "k"]).assign(rn=lambda d: d.groupby("g", dropna=False).cumcount() + 1).sort_values("k")
    assert got["rn"].tolist() == exp["rn"].tolist()


@pytest.mark.parametrize("values", ["gamma", "two", "fifty"])
@pytest.mark.parametrize("parts", [1, 8])
def test_quantiles_are_exact(spark, values, parts):
    """Continuous, two-value and fifty-value columns, a hot group, a null key
    and a group without values."""
    shuffle_partitions(spark, parts)
    rng = np.random.default_rng(3)
    x = {"gamma": np.round(rng.gamma(2.0, 3.0, 2234), 1), "two": (np.arange(2234) // 2 % 2).astype(float),
         "fifty": rng.integers(1, 51, 2234).astype(float)}[values]
    pdf = pd.DataFrame({"g": ["hot"] * 2000 + ["b"] * 200 + [None] * 30 + ["none"] * 4, "x": x})
    pdf.loc[::13, "x"] = np.nan
    pdf.loc[pdf["g"] == "none", "x"] = np.nan
    df = spark.createDataFrame([(g, None if np.isnan(v) else float(v)) for g, v in pdf.itertuples(index=False)], "g string, x double")
    qs = [0.05, 0.5, 0.95]
    got = {r["g"]: [r[f"q{i}"] for i in range(3)] for r in S.group_quantiles(df, ["g"], "x", qs).collect()}
    exp = pdf.groupby("g", dropna=False)["x"].quantile(qs).unstack()
    assert got.pop("none") == [None] * 3
    assert set(got) == {"hot", "b", None}
    for g, v in got.items():
        row = exp.loc[g] if g is not None else exp.loc[exp.index.isna()].iloc[0]
        assert np.allclose(v, row.values, atol=1e-12)
    glob = S.fit_stats(df, {"x": ["q0.05", "median", "q0.95", "mean"]})
    assert [glob[("x", s)] for s in ("q0.05", "median", "q0.95")] == pytest.approx(pdf["x"].quantile(qs).tolist(), abs=1e-12)
    one = S.group_quantiles(df.where("g = 'none'"), [], "x", [0.5]).collect()
    assert [r["q0"] for r in one] == [None]
