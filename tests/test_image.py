import numpy as np
import pandas as pd
import pytest

from strata.operators import image as I


def otsu_numpy(v, bins=256):
    """Otsu on a ``bins``-bin histogram over [min, max] (bin centres,
    between-class variance w1(k) w2(k+1) (m1(k) - m2(k+1))^2, first maximum)."""
    if v.min() == v.max():
        return float(v.min())
    hist, edges = np.histogram(v, bins=bins, range=(v.min(), v.max()))
    centers = (edges[:-1] + edges[1:]) / 2
    hist = hist.astype(float)
    w1 = np.cumsum(hist)
    w2 = np.cumsum(hist[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m1 = np.cumsum(hist * centers) / w1
        m2 = (np.cumsum((hist * centers)[::-1]) / w2[::-1])[::-1]
    var = w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2
    var = np.where(np.isnan(var), -1.0, var)
    return float(centers[int(np.argmax(var))])


def image_frame(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for img in range(4):
        v = np.concatenate([rng.normal(0.2, 0.05, 40), rng.normal(0.7, 0.1, 24)])
        if img == 3:
            v = np.full(64, 0.5)                     # flat image
        for pos, x in enumerate(v):
            rows.append((img, pos // 8, pos % 8, float(x)))
    return pd.DataFrame(rows, columns=["image_id", "y", "x", "v"])


@pytest.mark.parametrize("seed", [0, 1])
def test_otsu_matches_histogram_definition(spark, seed):
    pdf = image_frame(seed)
    got = {r["image_id"]: r["otsu_threshold"] for r in I.otsu_threshold(spark.createDataFrame(pdf), 256).collect()}
    for img, g in pdf.groupby("image_id"):
        assert got[img] == pytest.approx(otsu_numpy(g["v"].to_numpy()), abs=1e-9)


def test_cooccurrence_matches_numpy(spark):
    pdf = image_frame(2)
    out = {r["image_id"]: r for r in I.cooccurrence_texture(spark.createDataFrame(pdf), 8).collect()}
    for img, g in pdf.groupby("image_id"):
        v = g.sort_values(["y", "x"])["v"].to_numpy().reshape(8, 8)
        lo, hi = v.min(), v.max()
        lv = np.zeros_like(v, dtype=int) if hi == lo else np.floor((v - lo) / (hi - lo) * 7).astype(int)
        P = np.zeros((8, 8))
        for row in lv:
            for a, b in zip(row[:-1], row[1:]):
                P[a, b] += 1
                P[b, a] += 1
        P /= P.sum()
        i, j = np.indices(P.shape)
        assert out[img]["contrast"] == pytest.approx((P * (i - j) ** 2).sum())
        assert out[img]["homogeneity"] == pytest.approx((P / (1 + (i - j) ** 2)).sum())
        assert out[img]["energy"] == pytest.approx(np.sqrt((P ** 2).sum()))


def test_cooccurrence_computes_its_counts_once(spark):
    """A task held the sorts and tables of every copy of the counts at once."""
    plan = I.cooccurrence_texture(spark.createDataFrame(image_frame(2)), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [lead(") == 1


def test_cooccurrence_with_missing_pixels_and_gaps(spark):
    """Pairs with a missing pixel count in the total but in no moment."""
    rows = [(1, 0, 0, 0.0), (1, 0, 1, 7.0), (1, 0, 2, None), (1, 0, 3, 3.0), (1, 0, 5, 4.0), (1, 1, 0, 7.0), (1, 1, 1, 7.0), (2, 0, 0, 5.0), (None, 0, 0, 1.0), (None, 0, 1, 2.0)]
    out = I.cooccurrence_texture(spark.createDataFrame(rows, "image_id int, y int, x int, v double"), 8).collect()
    assert [r["image_id"] for r in out] == [1]
    cells = {(0, 7): 1, (7, 0): 1, (7, None): 1, (None, 7): 1, (None, 3): 1, (3, None): 1, (7, 7): 2}
    p = {c: n / 8 for c, n in cells.items()}
    full = {c: n for c, n in p.items() if None not in c}
    mu = sum(n * i for (i, _), n in p.items() if i is not None)
    assert out[0]["contrast"] == pytest.approx(sum(n * (i - j) ** 2 for (i, j), n in full.items()))
    assert out[0]["energy"] == pytest.approx(sum(n * n for n in p.values()) ** 0.5)
    var = sum(n * (i - mu) ** 2 for (i, _), n in p.items() if i is not None)
    assert out[0]["correlation"] == pytest.approx(sum(n * (i - mu) * (j - mu) for (i, j), n in full.items()) / var)
