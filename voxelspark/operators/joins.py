"""Operations of two images: equi-joins on the position.

Two images must have one size. With the headers of both, sizes are compared before any voxel is read; without them, a
voxel that only one image has raises when it is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, dense_grid, zip_voxels
from .stats import inside_mask, mean_sd, min_max  # noqa: F401  inside_mask belongs here too


def _divide(a: Column, b: Column) -> Column:
    return F.when(b > 1e-7, a / b).otherwise(a)


OPERATIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": _divide}


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_voxels(a, b, OPERATIONS["add"])


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_voxels(a, b, OPERATIONS["subtract"])


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_voxels(a, b, OPERATIONS["multiply"])


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b where b > 1e-7; elsewhere, also for negative b, a."""
    return zip_voxels(a, b, OPERATIONS["divide"])


def binary_op(a: DataFrame, b: DataFrame | None, op: str, factor: float = 1.0, offset: float = 0.0, a_images: DataFrame | None = None, b_images: DataFrame | None = None) -> DataFrame:
    """a op (b * factor + offset); without b, a op offset. Images of different sizes are an error."""
    f = OPERATIONS[op]
    if b is None:
        return a.select(*KEY, f(F.col("value"), F.lit(float(offset))).alias("value"))
    scaled = lambda x, y: f(x, y * factor + offset)
    if a_images is not None and b_images is not None:
        require_same_size(a_images, b_images)
        return zip_voxels(a, b, scaled)
    left, right = a.select(*KEY, F.struct("value").alias("a")), b.select(*KEY, F.struct("value").alias("b"))
    return matched(left, right, "a", "b").select(*KEY, scaled(F.col("a.value"), F.col("b.value")).alias("value"))


def matched(left: DataFrame, right: DataFrame, *present: str) -> DataFrame:
    """left and right joined by position; a position without one of the columns in present (structs of the two sides)
    raises."""
    at = F.concat_ws(", ", *(F.col(c).cast("string") for c in KEY))
    missing = F.raise_error(F.concat(F.lit("images differ in size: only one has the voxel "), at))
    one_sided = F.col(present[0]).isNull() | F.col(present[1]).isNull()
    both = left.join(right, KEY, "full")
    return both.withColumn(present[0], F.when(~one_sided, F.col(present[0])).otherwise(missing.cast(both.schema[present[0]].dataType)))


def require_same_size(a_images: DataFrame, b_images: DataFrame) -> None:
    """Raises for the first images, by id, whose headers differ in size, or that only one of the two tables has."""
    bad = [r["image_id"] for r in same_size(a_images, b_images).where("not same").orderBy("image_id").limit(5).collect()]
    if bad:
        raise ValueError(f"images differ in size: {bad}")


def fitting_mask(mask: DataFrame, images: DataFrame, mask_images: DataFrame) -> DataFrame:
    """The mask of each image whose mask has its size; 1 everywhere for an image with a mask of another size, which is
    ignored. Images without a mask have none. Only headers are compared; of the mask, voxels of fitting images are read."""
    judged = same_size(images, mask_images).join(mask_images.select("image_id"), "image_id", "left_semi")
    wrong = images.join(judged.where("not same").select("image_id"), "image_id", "left_semi")
    kept = mask.join(judged.where("same").select("image_id"), "image_id", "left_semi")
    return kept.select(*KEY, "value").unionByName(dense_grid(wrong).withColumn("value", F.lit(1.0)))


def apply_mask(a: DataFrame, mask: DataFrame) -> DataFrame:
    return multiply(a, mask)


def add_background(image: DataFrame, result: DataFrame, mask: DataFrame) -> DataFrame:
    """result + image * (1 - mask): both joins use one partitioning."""
    three = image.withColumnRenamed("value", "i").join(result.withColumnRenamed("value", "r"), KEY).join(mask.withColumnRenamed("value", "m"), KEY)
    return three.select(*KEY, (F.col("r") + F.col("i") * (1 - F.col("m"))).alias("value"))


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, same) from two tables of headers; an image that one of them lacks is not the same."""
    size = ["width", "height", "depth"]
    other = b.select("image_id", *(F.col(c).alias(f"{c}_2") for c in size))
    same = F.lit(True)
    for c in size:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return a.select("image_id", *size).join(other, "image_id", "full").select("image_id", same.alias("same"))


def normalize_statistics(image: DataFrame, reference: DataFrame, mode: str) -> DataFrame:
    """Gives each image the mean (mean_add, mean_scale), deviation (std) or range (range) of the reference. The values are
    null where the own mean, deviation or range is 0 and cannot be scaled."""
    mine = mean_sd(image).join(min_max(image), "image_id")
    theirs = mean_sd(reference).join(min_max(reference), "image_id").select("image_id", *(F.col(c).alias(f"{c}_2") for c in ("mean", "sd", "min", "max")))
    v = F.col("value")
    out = {
        "mean_add": v + (F.col("mean_2") - F.col("mean")),
        "mean_scale": v * F.try_divide("mean_2", "mean"),
        "std": v * F.try_divide("sd_2", "sd"),
        "range": v * F.try_divide(F.col("max_2") - F.col("min_2"), F.col("max") - F.col("min")),
    }[mode]
    return image.join(mine.join(theirs, "image_id"), "image_id").select(*KEY, out.alias("value"))


def grid_sweep(images: DataFrame, params: DataFrame) -> DataFrame:
    """Every image with every parameter set, with a run id. params is a small table of sets, a few hundred at most: it
    becomes one array that each image row is exploded with."""
    sets = params.agg(F.sort_array(F.collect_list(F.struct(*params.columns))).alias("sets")).withColumn("one", F.lit(1))
    each = images.withColumn("one", F.lit(1)).join(F.broadcast(sets), "one")
    out = each.select("image_id", F.posexplode("sets").alias("set_no", "p")).select("image_id", "set_no", "p.*")
    return out.withColumn("run_id", F.concat_ws("-", "image_id", "set_no"))
