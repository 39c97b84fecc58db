"""Images made from the star-schema tables, and the SQL that makes the same images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY, rasterize, voxels_from_array

IMG8 = """img8 AS MATERIALIZED (
  SELECT vec_id AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, 0 AS z,
         CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN range(1, 65) AS t(i))"""
VOL4 = """vol4 AS MATERIALIZED (
  SELECT vec_id AS image_id, CAST((i - 1) % 4 AS INTEGER) AS x, CAST(((i - 1) // 4) % 4 AS INTEGER) AS y,
         CAST((i - 1) // 16 AS INTEGER) AS z, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN range(1, 65) AS t(i))"""
SALES = """cells AS (
  SELECT dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS image_id,
         CAST(dayofyear(l_shipdate) - 1 AS INTEGER) AS x, CAST(l_quantity AS INTEGER) - 1 AS y,
         CAST(year(l_shipdate) - min(year(l_shipdate)) OVER () AS INTEGER) AS z, l_extendedprice AS price
  FROM lineitem),
sales AS (
  SELECT g.image_id, g.x, g.y, g.z, coalesce(c.value, 0) AS value
  FROM (SELECT i.image_id, CAST(x.v AS INTEGER) AS x, CAST(y.v AS INTEGER) AS y, CAST(z.v AS INTEGER) AS z
        FROM (SELECT DISTINCT image_id FROM cells) i CROSS JOIN range(0, 366) AS x(v) CROSS JOIN range(0, 50) AS y(v)
             CROSS JOIN range(0, 7) AS z(v)) g
  LEFT JOIN (SELECT image_id, x, y, z, sum(price) AS value FROM cells GROUP BY ALL) c USING (image_id, x, y, z))"""
EVENTS = """cells AS (
  SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS image_id, CAST(hour(ts) AS INTEGER) AS x,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS y, 0 AS z, value AS v
  FROM events),
raster AS (
  SELECT g.image_id, g.x, g.y, 0 AS z, coalesce(c.value, 0) AS value
  FROM (SELECT i.image_id, CAST(x.v AS INTEGER) AS x, CAST(y.v AS INTEGER) AS y
        FROM (SELECT DISTINCT image_id FROM cells) i CROSS JOIN range(0, 24) AS x(v) CROSS JOIN range(0, 30) AS y(v)) g
  LEFT JOIN (SELECT image_id, x, y, sum(v) AS value FROM cells GROUP BY ALL) c USING (image_id, x, y))"""
MASK8 = "mask8 AS MATERIALIZED (SELECT image_id, x, y, z, CASE WHEN value > avg(value) OVER (PARTITION BY image_id) THEN 1.0 ELSE 0.0 END AS value FROM img8)"
POS8 = "pos8 AS MATERIALIZED (SELECT image_id, x, y, z, value - min(value) OVER (PARTITION BY image_id) + 1 AS value FROM img8)"
PAIR8 = """pair8 AS MATERIALIZED (
  SELECT (vec_id - 1 + n) % n AS image_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, 0 AS z,
         CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) CROSS JOIN range(1, 65) AS t(i))"""

STRIPS = """strips AS MATERIALIZED (
  SELECT vec_id % {0} AS image_id, CAST(i - 1 AS INTEGER) AS x, CAST(vec_id // {0} AS INTEGER) AS y, 0 AS z, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings CROSS JOIN range(1, 65) AS t(i))"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images from the embeddings."""
    return voxels_from_array(_table(spark, sf_dir, "embeddings"), "embedding", 8, 8, id_col="vec_id")


def vol4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 volumes from the embeddings."""
    return voxels_from_array(_table(spark, sf_dir, "embeddings"), "embedding", 4, 4, 4, id_col="vec_id")


def strips(spark: SparkSession, sf_dir: str, images: int = 1) -> DataFrame:
    """Images 64 wide of all embeddings, a vector a line, dealt in turn to a number of images."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("x", "v"))
    return rows.select(F.pmod("vec_id", F.lit(images)).cast("long").alias("image_id"), F.col("x"), F.floor(F.col("vec_id") / images).cast("int").alias("y"), F.lit(0).alias("z"), F.col("v").cast("double").alias("value"))


def pair8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For image k of img8, the image (k + 1) mod n."""
    e = _table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    moved = e.join(F.broadcast(n), F.lit(True)).select(F.pmod(F.col("vec_id") - 1 + F.col("n"), F.col("n")).alias("image_id"), "embedding")
    return voxels_from_array(moved, "embedding", 8, 8)


def mask_of(voxels: DataFrame) -> DataFrame:
    """1 where a voxel is above its image's mean, else 0."""
    mean = voxels.groupBy("image_id").agg(F.avg("value").alias("mean"))
    return voxels.join(mean, "image_id").select(*KEY, F.when(F.col("value") > F.col("mean"), 1.0).otherwise(0.0).alias("value"))


def positive(voxels: DataFrame) -> DataFrame:
    low = voxels.groupBy("image_id").agg(F.min("value").alias("low"))
    return voxels.join(low, "image_id").select(*KEY, (F.col("value") - F.col("low") + 1).alias("value"))


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with image_id, the rank of their keys; the keys have few different values."""
    from pyspark.sql import Window

    ranks = rows.select(*keys).distinct().withColumn("image_id", (F.dense_rank().over(Window.orderBy(*keys)) - 1).cast("long"))
    return rows.join(F.broadcast(ranks), list(keys))


def sales_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six volumes of 366 x 50 x 7: sums of prices by day of the year, quantity and year."""
    rows = _ranked(_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice"), "l_returnflag", "l_linestatus")
    first = rows.agg(F.min(F.year("l_shipdate")).alias("first"))
    cells = rows.join(F.broadcast(first), F.lit(True)).select(
        "image_id", (F.dayofyear("l_shipdate") - 1).alias("x"), (F.col("l_quantity").cast("int") - 1).alias("y"), (F.year("l_shipdate") - F.col("first")).alias("z"), "l_extendedprice",
    )
    sizes = cells.select("image_id").distinct().select("image_id", F.lit(366).alias("width"), F.lit(50).alias("height"), F.lit(7).alias("depth"))
    return rasterize(cells, sizes, F.sum("l_extendedprice"))


def exact_sum(v: Column) -> Column:
    """The sum of doubles as decimals of 18 places, so that it does not depend on the order of rows; values of 1e9 and more,
    and those that are not finite, are added as they are."""
    plain = F.abs(v) < 1e9
    parts = F.sum(F.when(plain, v).cast("decimal(28, 18)")).cast("double"), F.sum(F.when(~plain, v))
    return F.when(parts[1].isNull(), parts[0]).otherwise(F.coalesce(parts[0], F.lit(0.0)) + parts[1])


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five images of 24 x 30: sums of values by hour and day."""
    rows = _ranked(_table(spark, sf_dir, "events").select("event_type", "ts", "value"), "event_type")
    cells = rows.select("image_id", F.hour("ts").alias("x"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("y"), F.lit(0).alias("z"), F.col("value").alias("v"))
    sizes = cells.select("image_id").distinct().select("image_id", F.lit(24).alias("width"), F.lit(30).alias("height"), F.lit(1).alias("depth"))
    return rasterize(cells, sizes, exact_sum(F.col("v")))
