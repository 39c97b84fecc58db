"""Aggregates of images, histograms, kernel densities, entropy, and choices from run tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, headers
from .durable import durable
from .windows import differences


def inside_mask(voxels: DataFrame, mask: DataFrame | None) -> DataFrame:
    """The voxels whose mask is not 0; all of them without a mask."""
    return voxels if mask is None else voxels.join(mask.where("value <> 0").select(*KEY).hint("merge"), KEY, "left_semi")


def min_max(voxels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    return inside_mask(voxels, mask).groupBy("image_id").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def mean_sd(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("image_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def image_information(voxels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Sizes, count, mean, sample deviation and variance, coefficient of variation (null where the mean is 0), range, sums:
    one partial aggregate. With headers, also their origin and spacing, and their sizes."""
    v = F.col("value")
    if images is not None:
        told = images.select("image_id", "width", "height", "depth", *(f"{k}{a}" for k in "os" for a in "xyz"))
        return image_information(voxels).drop("width", "height", "depth").join(told, "image_id")
    return voxels.groupBy("image_id").agg(
        *((F.max(a) + 1).cast("int").alias(n) for a, n in (("x", "width"), ("y", "height"), ("z", "depth"))),
        F.count(F.lit(1)).alias("voxel_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("variance"),
        F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(F.abs(v)).alias("sum_abs"), F.sum(v * v).alias("sum_sq"),
    )


def total_variation(voxels: DataFrame) -> DataFrame:
    """(image_id, tv, mean_tv): sum of absolute forward differences along all axes."""
    tv = F.sum(F.abs("dx") + F.abs("dy") + F.abs("dz"))
    return differences(voxels).groupBy("image_id").agg(tv.alias("tv"), (tv / F.count(F.lit(1))).alias("mean_tv"))


def normalized_cross_correlation(a: DataFrame, b: DataFrame, one_mean: bool = False) -> DataFrame:
    """(image_id, ncc); null where one of the images is constant. one_mean: deviations of both images are from the mean of
    the first, so images that differ by a constant are less alike than 1."""
    both = a.join(b.withColumnRenamed("value", "other"), KEY)
    spread = F.stddev_samp("other")
    if one_mean:
        n, apart = F.count(F.lit(1)), F.avg("other") - F.avg("value")
        spread = F.sqrt(F.var_samp("other") + F.try_divide(n * apart * apart, n - 1))
    ncc = F.try_divide(F.covar_pop("value", "other"), F.stddev_samp("value") * spread)
    return both.groupBy("image_id").agg(ncc.alias("ncc"))


def sum_abs_change(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("value", "other"), KEY)
    return both.groupBy("image_id").agg(F.sum(F.abs(F.col("value") - F.col("other"))).alias("change"))


def correlation_and_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, ncc, change): normalized_cross_correlation and sum_abs_change, from one join of the voxels."""
    both = a.join(b.withColumnRenamed("value", "other"), KEY)
    ncc = F.try_divide(F.covar_pop("value", "other"), F.stddev_samp("value") * F.stddev_samp("other"))
    return both.groupBy("image_id").agg(ncc.alias("ncc"), F.sum(F.abs(F.col("value") - F.col("other"))).alias("change"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), KEY).groupBy("image_id").agg(F.sum(F.col("value") * F.col("other")).alias("dot"))


def _all_bins(images: DataFrame, found: DataFrame, low: Column, width: Column, bins: Column | int, weight: str) -> DataFrame:
    """One row for each bin of each image: intensity, and the share of weight (1 for all where there is none)."""
    every = images.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins) - 1 if isinstance(bins, int) else bins - 1)))
    joined = every.join(found, ["image_id", "bin"], "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))
    total = F.sum(weight).over(Window.partitionBy("image_id"))
    return joined.select("image_id", "bin", (low + width * F.col("bin")).alias("intensity"), (F.col(weight) / F.when(total == 0, 1.0).otherwise(total)).alias("probability"))


def histogram(voxels: DataFrame, bins: int, low: float, high: float, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, bin, intensity, probability). bin = trunc((v - low) / width), so values just below low are in bin 0;
    values of high and above are left out."""
    width = (high - low) / bins
    near = inside_mask(voxels, mask).where((F.col("value") > low - 2 * width) & (F.col("value") < high + width))  # far ones need not fit an int
    placed = near.withColumn("bin", ((F.col("value") - low) / width).cast("int")).where(F.col("bin").between(0, bins - 1))
    counts = placed.groupBy("image_id", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return _all_bins(voxels.select("image_id").distinct(), counts, F.lit(float(low)), F.lit(width), bins, "n")


def kernel(u: Column, name: str) -> Column:
    return {
        "uniform": F.lit(1.0),
        "gaussian": F.exp(-u * u / 2) / math.sqrt(2 * math.pi),
        "cosine": F.lit(math.pi / 4) * F.cos(u * (math.pi / 2)),
        "epanechnikov": (1 - u * u) * 0.75,
    }[name]


def kde(voxels: DataFrame, bins: int, bandwidth: float, name: str, low: float, high: float, mask: DataFrame | None = None) -> DataFrame:
    """Kernel density at low + bin * width. Equal values are counted first, and a value only meets the grid points
    within the bandwidth, so there is no cross product."""
    width = (high - low) / bins
    near = inside_mask(voxels, mask).where(F.col("value").between(low - bandwidth, high + bandwidth))
    counted = near.groupBy("image_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return _density(counted, voxels.select("image_id").distinct(), F.lit(float(low)), F.lit(width), F.lit(bins), F.lit(float(bandwidth)), name)


def _density(counted: DataFrame, images: DataFrame, low: Column, width: Column, bins: Column, h: Column, name: str) -> DataFrame:
    first = F.greatest(F.lit(0), F.ceil((F.col("value") - h - low) / width).cast("int"))
    last = F.least(bins - 1, F.floor((F.col("value") + h - low) / width).cast("int"))
    near = counted.withColumns({"a": first, "b": last}).where("a <= b").withColumn("bin", F.explode(F.sequence("a", "b")))
    u = (low + width * F.col("bin") - F.col("value")) / h
    sums = near.where(F.abs(u) < 1).groupBy("image_id", "bin").agg(F.sum(F.col("n") * kernel(u, name)).alias("n"))
    return _all_bins(images, sums, low, width, bins, "n")


def entropy(histograms: DataFrame) -> DataFrame:
    p = F.col("probability")
    return histograms.groupBy("image_id").agg(F.sum(F.when(p >= 1e-5, -p * F.log2(p)).otherwise(0.0)).alias("entropy"))


def kde_entropy(voxels: DataFrame, mask: DataFrame | None = None, bandwidth: float = -1.0, window: tuple[float, float] | None = None) -> DataFrame:
    """Entropy of the Epanechnikov density with ceil(sqrt(N)) bins over the range, or the window; a bandwidth below 0 is
    the width of a bin. A constant image has entropy 0."""
    seen = inside_mask(voxels, mask)
    low, high = (F.min("value"), F.max("value")) if window is None else (F.lit(float(window[0])), F.lit(float(window[1])))
    span = seen.groupBy("image_id").agg(low.alias("low"), high.alias("high"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("bins"))
    span = span.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    h = F.col("width") if bandwidth < 0 else F.lit(float(bandwidth))
    counted = seen.groupBy("image_id", "value").agg(F.count(F.lit(1)).alias("n")).join(span, "image_id").where("width > 0")
    counted = counted.where(F.col("value").between(F.col("low") - h, F.col("high") + h))
    found = _density(counted, span.where("width > 0"), F.col("low"), F.col("width"), F.col("bins"), h, "epanechnikov")
    return span.select("image_id").join(entropy(found), "image_id", "left").select("image_id", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def auto_window_bandwidth(voxels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    return min_max(voxels, mask).select("*", ((F.col("max") - F.col("min")) * 0.03).alias("bandwidth"))


#: Images (60 bytes each) up to which what is known of each is broadcast to the voxels.
BROADCAST_IMAGES = 200_000


def measured(voxels: DataFrame, entropies: bool = True) -> DataFrame:
    """(image_id, mean, cv, mean_tv, entropy): everything that an image is judged by, with one exchange of voxels.

    A first pass has counts, ranges and moments. In the second, a voxel of a cube adds its differences to the image's total
    variation, and its share to the density at the grid points within a bin's width; both are summed before they move."""
    v = F.col("value")
    known = voxels.groupBy("image_id").agg(F.count(F.lit(1)).alias("count"), F.avg(v).alias("mean"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv"), F.min(v).alias("low"), F.max(v).alias("high"))
    known = known.withColumn("bins", F.ceil(F.sqrt("count")).cast("int")).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    known = durable(known)
    few = F.broadcast(known) if known.count() <= BROADCAST_IMAGES else known
    steps = differences(voxels.select(*KEY, "value")).join(few.select("image_id", "low", "bins", "width"), "image_id")
    tv = F.struct(F.lit(-1).alias("item"), (F.abs("dx") + F.abs("dy") + F.abs("dz")).alias("part"))
    parts = F.array(tv)
    if entropies:
        at = F.try_divide(v - F.col("low"), F.col("width"))
        near = F.sequence(F.greatest(F.lit(0), F.ceil(at - 1).cast("int")), F.least(F.col("bins") - 1, F.floor(at + 1).cast("int")))
        u = lambda b: (F.col("low") + F.col("width") * b - v) / F.nullif(F.col("width"), F.lit(0.0))
        share = lambda b: F.struct(b.alias("item"), F.when(F.abs(u(b)) < 1, kernel(u(b), "epanechnikov")).otherwise(0.0).alias("part"))
        parts = F.when((F.col("width") > 0) & (F.ceil(at - 1) <= F.col("bins") - 1), F.concat(parts, F.transform(near, share))).otherwise(parts)
    sums = steps.select("image_id", F.explode(parts).alias("p")).groupBy("image_id", "p.item").agg(F.sum("p.part").alias("part"))
    density = F.col("item") >= 0
    total = F.sum(F.when(density, F.col("part"))).over(Window.partitionBy("image_id"))
    p = F.when(density, F.try_divide("part", total))
    shares = sums.withColumn("h", F.when(p >= 1e-5, -p * F.log2(p)).otherwise(0.0))
    found = shares.groupBy("image_id").agg(F.max(F.when(F.col("item") == -1, F.col("part"))).alias("tv"), F.sum("h").alias("entropy"))
    return known.join(found, "image_id").select("image_id", "mean", "cv", (F.col("tv") / F.col("count")).alias("mean_tv"), *(["entropy"] if entropies else []))


def image_metrics(voxels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(image_id, mean, cv, mean_tv, entropy): what a run is judged by. A constant image has entropy 0; with a mask, the
    entropy is that of the voxels inside it."""
    if mask is None:
        return measured(voxels)
    return measured(voxels, entropies=False).join(kde_entropy(voxels, mask), "image_id")


def run_metrics(denoised: DataFrame, deshaded: DataFrame) -> DataFrame:
    """Coefficient of variation and TV of both images of a run, and the entropy of the deshaded one; image_id is the run."""
    named = lambda v, p, *more: v.select("image_id", F.col("cv").alias(f"{p}_cv"), F.col("mean_tv").alias(f"{p}_tv"), *more)
    both = named(measured(denoised, entropies=False), "denoised")
    return both.join(named(measured(deshaded), "deshaded", F.col("entropy").alias("deshaded_entropy")), "image_id")


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change in per cent of entropy, cv and mean_tv: (before - after) / before * 100; null where before is 0 or null."""
    names = ("entropy", "cv", "mean_tv")
    both = before.select("image_id", *names).join(after.select("image_id", *(F.col(c).alias(f"{c}_2") for c in names)), "image_id")
    return both.select("image_id", *((F.try_divide(F.col(c) - F.col(f"{c}_2"), F.col(c)) * 100).alias(c) for c in names))


def select_minimum(runs: DataFrame, metric: str, *params: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The parameters of the run with the least metric, the smallest id among equals."""
    best = F.min(F.struct(F.col(metric), F.col("id"), *(F.col(p) for p in params)))
    return runs.where(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("r")).select(*by, "r.id", f"r.{metric}", *(f"r.{p}" for p in params))


def next_search_space(runs: DataFrame, metric: str, *params: str) -> DataFrame:
    """For each parameter: the minimum's value -/+ (max - min) / number of different values."""
    best = select_minimum(runs, metric, *params)
    spans = runs.agg(*(((F.max(p) - F.min(p)) / F.count_distinct(p)).alias(f"{p}_step") for p in params))
    both = best.withColumn("one", F.lit(1)).join(spans.withColumn("one", F.lit(1)), "one")
    return both.select(*(c for p in params for c in ((F.col(p) - F.col(f"{p}_step")).alias(f"{p}_min"), (F.col(p) + F.col(f"{p}_step")).alias(f"{p}_max"))))


#: The ratios that are tried, in the search of step sizes and in the scan of alphas.
SCAN_RATIOS = (1.0, 1.2, 1.8, 2.0, 2.2)
RATIOS = (1.0, 1.5, 1.8, 2.0, 2.2, 2.3, 2.35, 2.4, 2.45)


#: Relative difference below which two metrics are equal, whatever the order of their sums was.
EQUAL = 1e-9


def select_step_sizes(history: DataFrame) -> DataFrame:
    """history: (run, i, metric) for alpha = 10^-i -> the interval before the first drop, by more than EQUAL, per run."""
    along = Window.partitionBy("run").orderBy("i")
    drops = history.withColumn("before", F.lag("metric").over(along)).where(F.col("metric") < F.col("before") - EQUAL * F.abs("before"))
    return drops.groupBy("run").agg((F.min("i") - 1).alias("interval"))


def best_ratio(scores: DataFrame) -> DataFrame:
    """scores: (run, ratio, metric) -> the ratio with the highest metric, the smallest among those that are EQUAL to it; a
    metric that is null is below all others."""
    known = scores.withColumn("metric", F.coalesce("metric", F.lit(float("-inf"))))
    top = F.max("metric").over(Window.partitionBy("run"))
    near = known.withColumn("top", top).where((F.col("metric") == F.col("top")) | (F.col("metric") >= F.col("top") - EQUAL * F.abs("top")))
    return near.groupBy("run").agg(F.min("ratio").alias("ratio"))


def images_of(voxels: DataFrame) -> DataFrame:
    return headers(voxels)
