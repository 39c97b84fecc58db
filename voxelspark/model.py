"""The tables: voxels(image_id, x, y, z, value), one row per voxel and dense, and headers with sizes and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "x", "y", "z"]
AXES = ("x", "y", "z")
SIZE = {"x": "width", "y": "height", "z": "depth"}


def headers(voxels: DataFrame) -> DataFrame:
    """(image_id, width, height, depth, ox, oy, oz, sx, sy, sz) with origin 0 and spacing 1."""
    sizes = voxels.groupBy("image_id").agg(*((F.max(a) + 1).cast("int").alias(n) for a, n in SIZE.items()))
    return sizes.select("*", *(F.lit(0.0).alias(f"o{a}") for a in AXES), *(F.lit(1.0).alias(f"s{a}") for a in AXES))


def voxels_from_array(df: DataFrame, array: str, width: int, height: int, depth: int = 1, id_col: str = "image_id") -> DataFrame:
    """Voxels of flat arrays, x fastest. Null or short arrays give the voxels they have; longer ones are cut."""
    n = width * height * depth
    flat = df.select(F.col(id_col).alias("image_id"), F.posexplode(F.slice(F.col(array), 1, n)).alias("i", "v"))
    return flat.select("image_id", *from_linear_index(F.col("i"), width, height), F.col("v").cast("double").alias("value"))


def linear_index(width: Column | int, height: Column | int) -> Column:
    return F.col("z") * width * height + F.col("y") * width + F.col("x")


def from_linear_index(i: Column, width: int, height: int) -> list[Column]:
    return [(i % width).cast("int").alias("x"), (F.floor(i / width) % height).cast("int").alias("y"), F.floor(i / (width * height)).cast("int").alias("z")]


def dense_grid(images: DataFrame) -> DataFrame:
    """(image_id, x, y, z) for every voxel of the headers; rows are made where they are needed, axis by axis."""
    out = images
    for a, n in (("z", "depth"), ("y", "height"), ("x", "width")):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return out.select(*KEY)


def rasterize(records: DataFrame, images: DataFrame, value: Column) -> DataFrame:
    """A dense image from records (image_id, x, y, z, ...): value (an aggregate) per cell, 0 where there is none.

    Records outside their image are dropped."""
    cells = records.groupBy(*KEY).agg(value.alias("value"))
    return dense_grid(images).join(cells, KEY, "left").select(*KEY, F.coalesce("value", F.lit(0.0)).alias("value"))


def is_dense(voxels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, dense): whether the image has width * height * depth voxels."""
    counts = voxels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return images.join(counts, "image_id", "left").select("image_id", (F.coalesce("n", F.lit(0)) == F.col("width") * F.col("height") * F.col("depth")).alias("dense"))


#: Images up to which a table with a row an image is broadcast.
MOST_IMAGES = 20_000


def by_image(images: DataFrame) -> DataFrame:
    """A table with a row an image, hinted for a join by image_id. Spark's estimates take an array that becomes rows for one
    row, so left to itself it may broadcast voxels; here a table of few images is broadcast, else both sides are sorted."""
    return F.broadcast(images) if images.count() <= MOST_IMAGES else images.hint("merge")


def map_voxels(voxels: DataFrame, f) -> DataFrame:
    """value -> f(value), f from Column to Column."""
    return voxels.select(*KEY, f(F.col("value")).alias("value"))


def zip_voxels(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f(value of a, value of b) at equal positions; voxels that only one of them has are dropped."""
    return a.join(b.withColumnRenamed("value", "other"), KEY).select(*KEY, f(F.col("value"), F.col("other")).alias("value"))
