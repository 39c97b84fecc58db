"""Synthetic test images: shading fields and what they do to an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, zip_voxels


def _grid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n * n).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"), F.lit(0).alias("z"))


def normalize(voxels: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each image's range mapped to [low, high]; a constant image becomes low."""
    from ..operators.pixel import rescale

    return rescale(voxels, low, high)


def make_linear_bias(spark: SparkSession, size: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    ramp = _grid(spark, size).select(*KEY, (F.col("x") + F.col("y")).cast("double").alias("value"))
    return normalize(ramp, low, high)


def make_z_field(spark: SparkSession, n: int, mu: float = 0.01, nu: float = 0.01, zz: float = 0.5) -> DataFrame:
    """1/2 (xy - zz)^2 + 1/2 nu y^2 + mu |x| on [-1, 1]^2, normalised and turned over."""
    at = lambda c: (F.col(c) * (2.0 / max(1, n - 1)) - 1)
    x, y = at("x"), at("y")
    z = 0.5 * (x * y - zz) * (x * y - zz) + 0.5 * nu * y * y + mu * F.abs(x)
    field = normalize(_grid(spark, n).select(*KEY, z.alias("value")))
    return field.withColumn("value", 1 - F.col("value"))


def apply_bias(voxels: DataFrame, field: DataFrame, how: str = "add") -> DataFrame:
    """Sum or product with the field, normalised."""
    return normalize(zip_voxels(voxels, field, (lambda a, b: a + b) if how == "add" else (lambda a, b: a * b)))
