"""Scalar maths, thresholds, geometry and drawn masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, dense_grid, headers
from .stats import min_max

TINY = 1e-7


def invert(v: Column) -> Column:
    return 1 - v


def binarize(v: Column) -> Column:
    return F.when(F.abs(v) > TINY, 1.0).otherwise(0.0)


def log(v: Column) -> Column:
    """Natural logarithm by IEEE rules: -inf for 0, NaN below."""
    return F.when(v > 0, F.log(v)).when(v == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def clamp_negative(v: Column, c: float) -> Column:
    return F.when(v < 0, F.lit(float(c))).otherwise(v)


def threshold(v: Column, low: float, high: float, outside: float) -> Column:
    return F.when(v.between(low, high), v).otherwise(F.lit(float(outside)))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(v, F.lit(float(high))))


def shrink(v: Column, by: float) -> Column:
    """Soft threshold; values up to 1e-6 become 0."""
    return F.when((F.abs(v) > 1e-6) & (F.abs(v) > by), F.signum(v) * (F.abs(v) - by)).otherwise(0.0)


def rescale(voxels: DataFrame, low: float, high: float, mask: DataFrame | None = None) -> DataFrame:
    """Linear map of each image's range (inside the mask, if any) to [low, high]; a constant image becomes low."""
    span = F.col("max") - F.col("min")
    v = F.when(span == 0, F.lit(float(low))).otherwise((F.col("value") - F.col("min")) * ((high - low) / span) + low)
    return voxels.join(min_max(voxels, mask), "image_id").select(*KEY, v.alias("value"))


def rotate180_in_plane(voxels: DataFrame, images: DataFrame) -> DataFrame:
    turned = voxels.join(images.select("image_id", "width", "height"), "image_id")
    return turned.select("image_id", (F.col("width") - 1 - F.col("x")).alias("x"), (F.col("height") - 1 - F.col("y")).alias("y"), "z", "value")


def extract(voxels: DataFrame, x0: int, x1: int, y0: int, y1: int, z0: int = 0, z1: int = 0, images: DataFrame | None = None) -> DataFrame:
    """The inclusive box, counted from 0; its far end is cut by the image. A start outside an image is an error, which is
    told by the headers; they are made from the voxels where they are not given. The filter reaches the scan."""
    _require_start(headers(voxels) if images is None else images, x0, y0, z0)
    box = voxels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & F.col("z").between(z0, z1))
    return box.select("image_id", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), (F.col("z") - z0).alias("z"), "value")


def _require_start(images: DataFrame, x: int, y: int, z: int) -> None:
    outside = contains(images, x, y, z).where("not inside").orderBy("image_id").limit(5)
    if bad := [r["image_id"] for r in outside.collect()]:
        raise ValueError(f"({x}, {y}, {z}) is outside of images {bad}")


def extract_header(images: DataFrame, x0: int, x1: int, y0: int, y1: int, z0: int = 0, z1: int = 0) -> DataFrame:
    """Headers of extracted boxes, whose origin moves by the start times the spacing; a start outside an image is an error."""
    _require_start(images, x0, y0, z0)
    out = images
    for n, a, lo, hi in (("width", "x", x0, x1), ("height", "y", y0, y1), ("depth", "z", z0, z1)):
        out = out.withColumn(n, F.least(F.col(n), F.lit(hi + 1)) - lo).withColumn(f"o{a}", F.col(f"o{a}") + F.lit(float(lo)) * F.col(f"s{a}"))
    return out


def extract_slice(voxels: DataFrame, z: int) -> DataFrame:
    return voxels.where(F.col("z") == z).withColumn("z", F.lit(0))


def set_geometry(images: DataFrame, origin: tuple[float, float, float], spacing: tuple[float, float, float]) -> DataFrame:
    values = {f"o{a}": F.lit(float(o)) for a, o in zip("xyz", origin, strict=True)} | {f"s{a}": F.lit(float(s)) for a, s in zip("xyz", spacing, strict=True)}
    return images.withColumns(values)


def contains(images: DataFrame, x: int, y: int, z: int) -> DataFrame:
    inside = (F.lit(x) >= 0) & (F.lit(x) < F.col("width")) & (F.lit(y) >= 0) & (F.lit(y) < F.col("height")) & (F.lit(z) >= 0) & (F.lit(z) < F.col("depth"))
    return images.select("image_id", inside.alias("inside"))


def pixel_at(voxels: DataFrame, x: int, y: int, z: int = 0) -> DataFrame:
    return voxels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).select("image_id", "value")


def display_byte(voxels: DataFrame, low: float | None = None, high: float | None = None, mask: DataFrame | None = None, rescaled: bool = True, multiplied: bool = False) -> DataFrame:
    """Window clamp (if low and high are given), then a rescaling to 0..255 by the range inside the mask, or, without
    rescaling, plus the image's minimum and, if asked, times 255; truncated and clamped to a byte. class: below or above
    the window, outside the mask, or inside."""
    window = low is not None and high is not None
    shown = voxels.withColumn("value", clamp(F.col("value"), low, high)) if window else voxels
    if rescaled:
        scaled = rescale(shown, 0, 255, mask)
    else:
        least = min_max(voxels).select("image_id", "min")
        scaled = shown.join(least, "image_id").select(*KEY, ((F.col("value") + F.col("min")) * (255 if multiplied else 1)).alias("value"))
    both = scaled.withColumnRenamed("value", "scaled").join(voxels, KEY)
    kind = F.lit("inside")
    if window:
        kind = F.when(F.col("value") < low, "below").when(F.col("value") > high, "above").otherwise(kind)
    if mask is not None:
        both = both.join(mask.select(*KEY, F.col("value").alias("m")), KEY, "left")
        kind = F.when(F.coalesce("m", F.lit(0.0)) == 0, "outside").otherwise(kind)
    byte = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("scaled"))).cast("int")
    return both.select(*KEY, byte.alias("byte"), kind.alias("class"))


#: Crossings of polygons' edges and rows (12 bytes each) up to which they are broadcast.
BROADCAST_CROSSINGS = 1_000_000


def polygon_mask(images: DataFrame, polygons: DataFrame) -> DataFrame:
    """polygons: (poly_id, vertex, x, y, slice), one drawing for all images. 1 inside (non-zero winding) on the slice of
    the first vertex, else 0. An edge holds the rows y1 <= y < y2 or y2 <= y < y1; a polygon's edges are few."""
    from pyspark.sql import Window

    ring = Window.partitionBy("poly_id").orderBy("vertex")
    whole = Window.partitionBy("poly_id")
    first = lambda c: F.min_by(c, "vertex").over(whole)
    edges = polygons.select(
        "poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(ring), first("x")).alias("x2"),
        F.coalesce(F.lead("y").over(ring), first("y")).alias("y2"), first("slice").alias("z"),
    )
    # An edge meets the rows between its ends: it is dealt to those rows, and joined by (z, y).
    rows = edges.where("y1 <> y2").select("*", F.explode(F.sequence(F.ceil(F.least("y1", "y2")).cast("int"), (F.ceil(F.greatest("y1", "y2")) - 1).cast("int"))).alias("y"))
    meets = rows.select("poly_id", "z", "y", (F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("at"), F.when(F.col("y2") > F.col("y1"), 1).otherwise(-1).alias("turn"))
    # Few rows, so the voxels stay where they are made; each looks up the crossings of its row, polygon by polygon.
    drawn = meets.groupBy("z", "y", "poly_id").agg(F.collect_list(F.struct("at", "turn")).alias("meets"))
    drawn = drawn.groupBy("z", "y").agg(F.collect_list("meets").alias("polygons"))
    turns = lambda meets: F.aggregate(F.filter(meets, lambda m: m["at"] > F.col("x")), F.lit(0), lambda n, m: n + m["turn"])
    inside = F.exists("polygons", lambda meets: turns(meets) != 0)
    drawn = F.broadcast(drawn) if meets.count() <= BROADCAST_CROSSINGS else drawn.hint("merge")
    return dense_grid(images).join(drawn, ["z", "y"], "left").select(*KEY, F.when(inside, 1.0).otherwise(0.0).alias("value"))


def brush_shading(voxels: DataFrame, strokes: DataFrame, size: int, sigma: float, top: float) -> DataFrame:
    """strokes: (stroke_id, x, y, z, increase). Every stroke multiplies (or divides) the shading, 1 at first, by
    1 + (top - 1) exp(-r^2 / sigma) in a box of `size` voxels an axis around its centre, voxel size // 2; the result is
    the image times the shading."""
    around = F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2))
    spots = strokes
    for a in ("dx", "dy", "dz"):
        spots = spots.withColumn(a, F.explode(around))
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    gain = F.log(1 + (top - 1) * F.exp(-r2 / sigma))
    spots = spots.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"), F.when(F.col("increase"), gain).otherwise(-gain).alias("gain"))
    shading = spots.groupBy("x", "y", "z").agg(F.exp(F.sum("gain")).alias("shading"))
    return voxels.join(shading, ["x", "y", "z"], "left").select(*KEY, (F.col("value") * F.coalesce("shading", F.lit(1.0))).alias("value"))


def labels_from_seeds(images: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: (segment_id, x, y, z): 0, and at seeds the highest segment's number."""
    marks = seeds.groupBy("x", "y", "z").agg(F.max("segment_id").cast("double").alias("value"))
    return dense_grid(images).join(marks, ["x", "y", "z"], "left").select(*KEY, F.coalesce("value", F.lit(0.0)).alias("value"))


def mask_edge_class(mask: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Voxels of the mask (>= 1) with flags for the borders of the image that they touch."""
    images = headers(mask) if images is None else images
    inside = mask.where("value >= 1").join(images.select("image_id", "width", "height", "depth"), "image_id")
    flags = {"left": F.col("x") == 0, "right": F.col("x") == F.col("width") - 1, "top": F.col("y") == 0, "bottom": F.col("y") == F.col("height") - 1, "front": F.col("z") == 0, "back": F.col("z") == F.col("depth") - 1}
    return inside.select(*KEY, *(c.alias(k) for k, c in flags.items()))
