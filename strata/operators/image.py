"""Image-intensity table jobs.

Images are long tables ``(image_id, y, x, v)`` (e.g. ``posexplode`` of an
array column).  Per-image statistics are ``groupBy(image)`` aggregates;
neighbourhood operators (co-occurrence pairs, Sobel gradient) use
``lag`` / ``lead`` over rows and columns of one image; histograms are
aggregates on a computed bin column.  Nothing is collected per image.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import group_quantiles


def pixels_from_array(df: DataFrame, image: str, arr: str, width: int) -> DataFrame:
    """Long pixel table from an array column laid out row-major ``width`` wide."""
    return (df.select(F.col(image).alias("image_id"), F.posexplode(arr).alias("pos", "v"))
            .select("image_id", F.floor(F.col("pos") / width).cast("int").alias("y"),
                    (F.col("pos") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v")))


def intensity_stats(px: DataFrame) -> DataFrame:
    """Mean, population std, min, max, median, p25, p75, contrast
    (max - min), biased skewness and (non-excess) kurtosis; 0 for a flat image."""
    v = F.col("v")
    g = px.groupBy("image_id").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("_sk"), F.kurtosis(v).alias("_ku"))
    g = g.join(group_quantiles(px, ["image_id"], "v", [0.5, 0.25, 0.75], ["median", "p25", "p75"]), "image_id")
    flat = F.col("std") == 0
    return g.select("image_id", "mean", "std", "min", "max", "median", "p25",
                    "p75", (F.col("max") - F.col("min")).alias("contrast"),
                    F.when(flat, 0.0).otherwise(F.col("_sk")).alias("skewness"),
                    F.when(flat, 0.0).otherwise(F.col("_ku") + 3.0).alias("kurtosis"))


def _with_range(px: DataFrame) -> DataFrame:
    r = px.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("v").alias("_n"))
    return px.join(r, "image_id")


def _bin_index(bins: int):
    """numpy histogram over [min, max]: equal bins, the last one closed; a
    flat image uses the range [v - 0.5, v + 0.5]."""
    lo = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    return idx, width, lo


def histogram_entropy(px: DataFrame, bins: int = 50) -> DataFrame:
    """Density histogram (counts / (N x width)); entropy
    -sum(h log2 h) and energy sum(h^2) over non-empty bins."""
    idx, width, _ = _bin_index(bins)
    h = (_with_range(px).withColumn("_b", idx).withColumn("_w", width)
         .groupBy("image_id", "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_w").alias("_w"))
         .withColumn("_h", F.col("_c") / (F.col("_n") * F.col("_w"))))
    return h.groupBy("image_id").agg((-F.sum(F.col("_h") * F.log2("_h"))).alias("entropy"),
                                     F.sum(F.col("_h") * F.col("_h")).alias("energy"))


def otsu_threshold(px: DataFrame, bins: int = 256) -> DataFrame:
    """I4: Otsu threshold per image on a ``bins``-bin histogram over
    [min, max]: the bin centre maximising the between-class variance
    w1(k) w2(k+1) (m1(k) - m2(k+1))^2 (first maximum, to 6 decimals); a flat image returns
    its value.  All bins of an image (a bounded grid) are materialised so
    that empty bins count as in the histogram definition."""
    idx, width, lo = _bin_index(bins)
    r = _with_range(px)
    counts = r.withColumn("_b", idx).groupBy("image_id", "_b").agg(F.count(F.lit(1)).alias("_c"))
    grid = (r.select("image_id", "_lo", "_hi").distinct()
            .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    lo_e = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    hi_e = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_hi") + 0.5)
    w_ = (hi_e - lo_e) / bins
    h = (grid.join(counts, ["image_id", "_b"], "left")
         .select("image_id", "_b", "_lo", "_hi", F.coalesce("_c", F.lit(0)).cast("double").alias("_c"),
                 (lo_e + (F.col("_b") + 0.5) * w_).alias("_ctr")))
    w = Window.partitionBy("image_id").orderBy("_b")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    h = (h.withColumn("_w1", F.sum("_c").over(up)).withColumn("_s1", F.sum(F.col("_c") * F.col("_ctr")).over(up))
         .withColumn("_w2", F.sum("_c").over(down)).withColumn("_s2", F.sum(F.col("_c") * F.col("_ctr")).over(down)))
    h = (h.withColumn("_m1", F.try_divide(F.col("_s1"), F.col("_w1"))).withColumn("_m2", F.try_divide(F.col("_s2"), F.col("_w2")))
         .withColumn("_w2n", F.lead("_w2").over(w)).withColumn("_m2n", F.lead("_m2").over(w)))
    var = F.col("_w1") * F.col("_w2n") * F.pow(F.col("_m1") - F.col("_m2n"), 2)
    h = h.withColumn("_var", F.coalesce(var, F.lit(-1.0))).where(F.col("_b") < bins - 1)
    # variances that agree to 6 decimals are one: sums in another order must not pick another bin
    best = h.groupBy("image_id").agg(F.max_by("_ctr", F.struct(F.round("_var", 6), -F.col("_b"))).alias("_t"),
                                     F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return best.select("image_id", F.when(F.col("_hi") > F.col("_lo"), F.col("_t")).otherwise(F.col("_lo")).alias("otsu_threshold"))


def region_stats(px: DataFrame, threshold: DataFrame | None = None, region: str = "whole_brain") -> DataFrame:
    """Mean / population std / median / min / max / volume of the pixels
    above the image's threshold (default: Otsu)."""
    thr = threshold if threshold is not None else otsu_threshold(px)
    m = px.join(thr, "image_id").where(F.col("v") > F.col("otsu_threshold"))
    g = m.groupBy("image_id").agg(
        F.avg("v").alias(f"{region}_mean"), F.stddev_pop("v").alias(f"{region}_std"),
        F.min("v").alias(f"{region}_min"), F.max("v").alias(f"{region}_max"), F.count(F.lit(1)).alias(f"{region}_volume"))
    med = group_quantiles(m, ["image_id"], "v", [0.5], [f"{region}_median"])
    return g.join(med, "image_id").select("image_id", f"{region}_mean", f"{region}_std", f"{region}_median",
                                          f"{region}_min", f"{region}_max", f"{region}_volume")


def band_ratios(px: DataFrame, cuts: Sequence[float] = (0.7, 0.4, 0.2)) -> DataFrame:
    """Image divided by its maximum (when > 0); shares of pixels above
    cut0, in (cut1, cut0], in (cut2, cut1]."""
    mx = px.groupBy("image_id").agg(F.max("v").alias("_mx"))
    n = F.when(F.col("_mx") > 0, F.col("v") / F.col("_mx")).otherwise(F.col("v"))
    a, b, c = cuts
    j = px.join(mx, "image_id").withColumn("_n", n)
    return j.groupBy("image_id").agg(
        F.avg((F.col("_n") > a).cast("double")).alias("region1_ratio"),
        F.avg(((F.col("_n") > b) & (F.col("_n") <= a)).cast("double")).alias("region2_ratio"),
        F.avg(((F.col("_n") > c) & (F.col("_n") <= b)).cast("double")).alias("region3_ratio"))


def grey_levels(px: DataFrame, levels: int = 256) -> DataFrame:
    """Rescale each image to 0 .. levels - 1 and truncate to integers."""
    r = px.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    g = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (levels - 1))).otherwise(0)
    return px.join(r, "image_id").select("image_id", "y", "x", g.cast("int").alias("g"))


def cooccurrence_texture(px: DataFrame, levels: int = 256) -> DataFrame:
    """Grey-level co-occurrence at distance 1, angle 0, symmetric and
    normalised: contrast, dissimilarity, homogeneity, energy (sqrt of the
    angular second moment) and correlation (1 for a flat matrix)."""
    g = grey_levels(px, levels)
    w = Window.partitionBy("image_id", "y").orderBy("x")
    pairs = (g.withColumn("_nx", F.lead("x").over(w)).withColumn("_ng", F.lead("g").over(w))
             .where(F.col("_nx") == F.col("x") + 1))
    # both directions of a pair in one reading; the counts are computed once and, as a matrix has at most
    # levels^2 cells, a window over an image's cells gives total and mean
    ways = F.explode(F.array(F.struct(F.col("g").alias("i"), F.col("_ng").alias("j")), F.struct(F.col("_ng").alias("i"), F.col("g").alias("j"))))
    cnt = pairs.select("image_id", ways.alias("_e")).groupBy("image_id", F.col("_e.i").alias("i"), F.col("_e.j").alias("j")).agg(
        F.count(F.lit(1)).cast("double").alias("_c"))
    wi = Window.partitionBy("image_id")
    p = cnt.withColumn("p", F.col("_c") / F.sum("_c").over(wi)).withColumn("_mu", F.sum(F.col("p") * F.col("i")).over(wi))
    d, off = (F.col("i") - F.col("j")).cast("double"), F.col("i") - F.col("_mu")
    out = p.groupBy("image_id").agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"),
        F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"),
        F.sum(F.col("p") * F.pow(off, 2)).alias("_var"), F.sum(F.col("p") * off * (F.col("j") - F.col("_mu"))).alias("_cov"))
    return out.select("image_id", "contrast", "dissimilarity", "homogeneity", "energy",
                      F.when(F.col("_var") < 1e-15, 1.0).otherwise(F.col("_cov") / F.col("_var")).alias("correlation"))


def gradient_stats(px: DataFrame, levels: int = 256) -> DataFrame:
    """3x3 Sobel gradient magnitude on the 0..255 image, mean over
    interior pixels (borders dropped) and homogeneity 1 / (1 + mean)."""
    g = grey_levels(px, levels).withColumn("g", F.col("g").cast("double"))
    wx = Window.partitionBy("image_id", "y").orderBy("x")
    step1 = g.select("*", (F.lead("g").over(wx) - F.lag("g").over(wx)).alias("_dx"),
                     (F.lag("g").over(wx) + 2 * F.col("g") + F.lead("g").over(wx)).alias("_sx"))
    wy = Window.partitionBy("image_id", "x").orderBy("y")
    step2 = step1.select("image_id", (F.lag("_dx").over(wy) + 2 * F.col("_dx") + F.lead("_dx").over(wy)).alias("gx"),
                         (F.lead("_sx").over(wy) - F.lag("_sx").over(wy)).alias("gy"))
    mag = step2.where(F.col("gx").isNotNull() & F.col("gy").isNotNull()).withColumn("_m", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    return mag.groupBy("image_id").agg(F.avg("_m").alias("local_contrast")).withColumn(
        "local_homogeneity", 1.0 / (1.0 + F.col("local_contrast")))


def normalise_intensity(px: DataFrame, how: str = "minmax") -> DataFrame:
    """I8: per image ``(v - min) / (max - min)`` or ``v / mean(v > 0)``
    (aggregate + join, so a large image is pre-aggregated map-side)."""
    if how == "minmax":
        r = px.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        e = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    else:
        r = px.groupBy("image_id").agg(F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("_pm"))
        e = F.try_divide(F.col("v"), F.col("_pm"))
    return px.join(r, "image_id").select("image_id", "y", "x", e.alias("v_norm"))


def series_manifest(files: DataFrame, patient: str, series: str, order: str, path: str, modality: str,
                    min_files: int = 10, want: str | None = None) -> DataFrame:
    """One row per (patient, series) with its files in slice order;
    series with fewer than ``min_files`` files or another modality are dropped."""
    f = files if want is None else files.where(F.col(modality) == want)
    g = f.groupBy(patient, series).agg(F.count(F.lit(1)).alias("n_files"), F.first(modality).alias("modality"),
                                       F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(path).alias("p")))).alias("_s"))
    return g.where(F.col("n_files") >= min_files).select(patient, series, "modality", "n_files",
                                                         F.transform("_s", lambda s: s["p"]).alias("files"))


def modality_means(df: DataFrame, modality: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each image feature per modality."""
    return df.groupBy(modality).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
