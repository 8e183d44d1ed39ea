"""Image-intensity operators I1-I10.

Binding (FIXTURES.md B): every ``embeddings`` vector is an 8 x 8 image
(``y = pos // 8``, ``x = pos % 8``); ``label`` plays the modality.  The
series manifest uses ``lineitem`` as the file table (patient = suppkey,
series = orderkey, slice order = linenumber, modality = returnflag).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import image as I
from .registry import register, rounded, table

PX = """px AS (SELECT vec_id AS image_id, CAST(floor((i - 1) / 8) AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
  CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"""


def px(spark, sf):
    return I.pixels_from_array(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


STATS_SQL = f"""{PX}, m AS (SELECT *, avg(v) OVER (PARTITION BY image_id) AS mu, var_pop(v) OVER (PARTITION BY image_id) AS vp FROM px),
st AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, max(v) - min(v) AS contrast,
  CASE WHEN max(vp) > 0 THEN avg(power(v - mu, 3)) / power(max(vp), 1.5) ELSE 0 END AS skewness,
  CASE WHEN max(vp) > 0 THEN avg(power(v - mu, 4)) / power(max(vp), 2) ELSE 0 END AS kurtosis FROM m GROUP BY image_id)"""


@register("i1_intensity_stats", f"""WITH {STATS_SQL} SELECT image_id, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max,
  round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(contrast, 6) AS contrast, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM st""")
def i1(spark, sf):
    return rounded(I.intensity_stats(px(spark, sf)))


@register("i2_histogram_entropy", f"""WITH {PX}, r AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi,
  count(*) OVER (PARTITION BY image_id) AS n FROM px),
b AS (SELECT image_id, n, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 / 50 END AS w,
  least(floor((v - CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END) / (CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 / 50 END)), 49) AS bin FROM r),
h AS (SELECT image_id, bin, count(*) / (max(n) * max(w)) AS h FROM b GROUP BY image_id, bin)
SELECT image_id, round(-sum(h * log2(h)), 6) AS entropy, round(sum(h * h), 6) AS energy FROM h GROUP BY image_id""")
def i2(spark, sf):
    return rounded(I.histogram_entropy(px(spark, sf), 50))


@register("i3_region_stats", f"""WITH {PX}, t AS (SELECT *, avg(v) OVER (PARTITION BY image_id) AS thr FROM px)
SELECT image_id, round(avg(v), 6) AS whole_brain_mean, round(stddev_pop(v), 6) AS whole_brain_std, round(median(v), 6) AS whole_brain_median,
  round(min(v), 6) AS whole_brain_min, round(max(v), 6) AS whole_brain_max, count(*) AS whole_brain_volume FROM t WHERE v > thr GROUP BY image_id""")
def i3(spark, sf):
    p = px(spark, sf)
    thr = p.groupBy("image_id").agg(F.avg("v").alias("otsu_threshold"))
    return rounded(I.region_stats(p, thr))


OTSU_SQL = f"""{PX}, rng AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id),
ed AS (SELECT image_id, lo, hi, CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS a, CASE WHEN hi > lo THEN (hi - lo) / 256 ELSE 1.0 / 256 END AS w FROM rng),
cnt AS (SELECT image_id, CAST(least(floor((v - a) / w), 255) AS INTEGER) AS b, count(*) AS c FROM px JOIN ed USING (image_id) GROUP BY ALL),
h AS (SELECT ed.image_id, lo, hi, g.b, coalesce(c, 0) AS c, a + (g.b + 0.5) * w AS ctr FROM ed CROSS JOIN range(0, 256) g(b) LEFT JOIN cnt ON cnt.image_id = ed.image_id AND cnt.b = g.b),
cum AS (SELECT *, sum(c) OVER up AS w1, sum(c * ctr) OVER up AS s1, sum(c) OVER down AS w2, sum(c * ctr) OVER down AS s2 FROM h
  WINDOW up AS (PARTITION BY image_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY image_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
bv AS (SELECT image_id, lo, hi, b, ctr, coalesce(w1 * w2 * power(s1 / nullif(w1, 0) - s2 / nullif(w2, 0), 2), -1) AS bv FROM cum WHERE b < 255),
otsu AS (SELECT image_id, CASE WHEN hi > lo THEN ctr ELSE lo END AS otsu_threshold FROM
  (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(bv, 6) DESC, b) AS r FROM bv) WHERE r = 1)"""


@register("i4_otsu_threshold", f"WITH {OTSU_SQL} SELECT image_id, round(otsu_threshold, 6) AS otsu_threshold FROM otsu")
def i4(spark, sf):
    return rounded(I.otsu_threshold(px(spark, sf), 256))


@register("i4_region_stats_otsu", f"""WITH {OTSU_SQL} SELECT image_id, round(avg(v), 6) AS whole_brain_mean, round(stddev_pop(v), 6) AS whole_brain_std,
  round(median(v), 6) AS whole_brain_median, round(min(v), 6) AS whole_brain_min, round(max(v), 6) AS whole_brain_max, count(*) AS whole_brain_volume
FROM px JOIN otsu USING (image_id) WHERE v > otsu_threshold GROUP BY image_id""")
def i4b(spark, sf):
    return rounded(I.region_stats(px(spark, sf)))


@register("i5_band_ratios", f"""WITH {PX}, n AS (SELECT image_id, CASE WHEN max(v) OVER (PARTITION BY image_id) > 0 THEN v / max(v) OVER (PARTITION BY image_id) ELSE v END AS n FROM px)
SELECT image_id, round(avg(CAST(n > 0.7 AS DOUBLE)), 6) AS region1_ratio, round(avg(CAST(n > 0.4 AND n <= 0.7 AS DOUBLE)), 6) AS region2_ratio,
  round(avg(CAST(n > 0.2 AND n <= 0.4 AS DOUBLE)), 6) AS region3_ratio FROM n GROUP BY image_id""")
def i5(spark, sf):
    return rounded(I.band_ratios(px(spark, sf)))


GREY = f"""{PX}, g AS (SELECT image_id, y, x, CAST(CASE WHEN max(v) OVER (PARTITION BY image_id) > min(v) OVER (PARTITION BY image_id)
  THEN floor((v - min(v) OVER (PARTITION BY image_id)) / (max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id)) * {{L1}}) ELSE 0 END AS INTEGER) AS g FROM px)"""


@register("i6_cooccurrence_texture", "WITH " + GREY.replace("{L1}", "7") + """,
pr AS (SELECT image_id, g AS i, lead(g) OVER (PARTITION BY image_id, y ORDER BY x) AS j, lead(x) OVER (PARTITION BY image_id, y ORDER BY x) AS nx, x FROM g),
b AS (SELECT image_id, i, j FROM pr WHERE nx = x + 1 UNION ALL SELECT image_id, j, i FROM pr WHERE nx = x + 1),
c AS (SELECT image_id, i, j, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT image_id, i, j, c / sum(c) OVER (PARTITION BY image_id) AS p FROM c),
mu AS (SELECT image_id, sum(p * i) AS mu FROM p GROUP BY image_id),
agg AS (SELECT p.image_id, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity,
  sqrt(sum(p * p)) AS energy, sum(p * (i - mu) * (i - mu)) AS var, sum(p * (i - mu) * (j - mu)) AS cov FROM p JOIN mu USING (image_id) GROUP BY p.image_id)
SELECT image_id, round(contrast, 6) AS contrast, round(dissimilarity, 6) AS dissimilarity, round(homogeneity, 6) AS homogeneity, round(energy, 6) AS energy,
  round(CASE WHEN var < 1e-15 THEN 1.0 ELSE cov / var END, 6) AS correlation FROM agg""")
def i6(spark, sf):
    return rounded(I.cooccurrence_texture(px(spark, sf), 8))


@register("i7_gradient_stats", "WITH " + GREY.replace("{L1}", "255") + """,
s1 AS (SELECT image_id, y, x, lead(g) OVER (PARTITION BY image_id, y ORDER BY x) - lag(g) OVER (PARTITION BY image_id, y ORDER BY x) AS dx,
  lag(g) OVER (PARTITION BY image_id, y ORDER BY x) + 2 * g + lead(g) OVER (PARTITION BY image_id, y ORDER BY x) AS sx FROM g),
s2 AS (SELECT image_id, lag(dx) OVER (PARTITION BY image_id, x ORDER BY y) + 2 * dx + lead(dx) OVER (PARTITION BY image_id, x ORDER BY y) AS gx,
  lead(sx) OVER (PARTITION BY image_id, x ORDER BY y) - lag(sx) OVER (PARTITION BY image_id, x ORDER BY y) AS gy FROM s1)
SELECT image_id, round(avg(sqrt(gx * gx + gy * gy)), 6) AS local_contrast, round(1.0 / (1.0 + avg(sqrt(gx * gx + gy * gy))), 6) AS local_homogeneity
FROM s2 WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY image_id""")
def i7(spark, sf):
    return rounded(I.gradient_stats(px(spark, sf)))


@register("i8_normalise_minmax", f"""WITH {PX} SELECT image_id, y, x, round((v - min(v) OVER (PARTITION BY image_id)) / nullif(max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id), 0), 6) AS v_norm FROM px""")
def i8(spark, sf):
    return rounded(I.normalise_intensity(px(spark, sf), "minmax"))


@register("i8_normalise_positive_mean", f"""WITH {PX} SELECT image_id, y, x, round(v / nullif(avg(v) FILTER (WHERE v > 0) OVER (PARTITION BY image_id), 0), 6) AS v_norm FROM px""")
def i8b(spark, sf):
    return rounded(I.normalise_intensity(px(spark, sf), "positive_mean"))


@register("i9_series_manifest", """SELECT l_suppkey, l_orderkey, 'R' AS modality, count(*) AS n_files,
  list('f' || CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, 'f' || CAST(l_linenumber AS VARCHAR)) AS files
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_orderkey HAVING count(*) >= 3""")
def i9(spark, sf):
    f = table(spark, sf, "lineitem").withColumn("path", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")))
    return I.series_manifest(f, "l_suppkey", "l_orderkey", "l_linenumber", "path", "l_returnflag", min_files=3, want="R")


@register("i10_modality_means", f"""WITH {STATS_SQL} SELECT label, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, round(avg(contrast), 6) AS contrast
FROM st JOIN embeddings ON image_id = vec_id GROUP BY label""")
def i10(spark, sf):
    s = I.intensity_stats(px(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label"), "image_id")
    return rounded(I.modality_means(s, "label", ["mean", "std", "contrast"]))
