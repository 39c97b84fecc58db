"""Differences and sums along lines, and values along drawn lines.

Differences along several axes need the voxel's neighbours on all of them. Voxels are dealt once, to cubes, each with the
faces of its neighbours; lines are then sorted within their cubes, without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, KEY


def _line(axis: str):
    return Window.partitionBy("image_id", *(a for a in AXES if a != axis)).orderBy(axis)


#: Voxels an axis of the cubes that differences are taken in.
CUBE = 64


def in_cubes(voxels: DataFrame, before: bool, after: bool, size: int = CUBE) -> DataFrame:
    """voxels by cubes (cx, cy, cz), each also with the next layer of the cubes before and after it as asked; own: whether
    a voxel is the cube's own. One exchange, by cube; images of any size go over many tasks."""
    own = {a: F.floor(F.col(a) / size).cast("int") for a in AXES}
    place = lambda axis, by: F.struct(*((own[a] + (by if a == axis else 0)).alias(f"c{a}") for a in AXES), F.lit(axis is None).alias("own"))
    none = F.array().cast("array<struct<cx:int,cy:int,cz:int,own:boolean>>")
    copies = [F.array(place(None, 0))]
    for a in AXES:
        if after:  # the first layer of a cube is the one after the cube before it
            copies.append(F.when((F.col(a) % size == 0) & (F.col(a) > 0), F.array(place(a, -1))).otherwise(none))
        if before:
            copies.append(F.when(F.col(a) % size == size - 1, F.array(place(a, 1))).otherwise(none))
    dealt = voxels.withColumn("cube", F.explode(F.concat(*copies)))
    return dealt.select(*voxels.columns, "cube.cx", "cube.cy", "cube.cz", "cube.own").repartition("image_id", "cx", "cy", "cz")


def _in_cube(axis: str):
    return Window.partitionBy("image_id", "cx", "cy", "cz", *(a for a in AXES if a != axis)).orderBy(axis)


def differences(voxels: DataFrame) -> DataFrame:
    """voxels with dx, dy and dz, the forward differences, 0 at the far borders."""
    out = in_cubes(voxels, before=False, after=True)
    for a in AXES:
        out = out.withColumn(f"d{a}", F.coalesce(F.lead("value").over(_in_cube(a)) - F.col("value"), F.lit(0.0)))
    return out.where("own").select(*voxels.columns, "dx", "dy", "dz")


def forward_difference(voxels: DataFrame, axis: str, keep: str | None = None) -> DataFrame:
    """next - own, 0 at the far border. With keep, it becomes a further column of that name."""
    d = F.coalesce(F.lead("value").over(_line(axis)) - F.col("value"), F.lit(0.0))
    return voxels.withColumn(keep, d) if keep else voxels.select(*KEY, d.alias("value"))


def backward_difference(voxels: DataFrame, axis: str) -> DataFrame:
    """previous - own, -own at the near border: the adjoint of forward_difference."""
    return voxels.select(*KEY, (F.coalesce(F.lag("value").over(_line(axis)), F.lit(0.0)) - F.col("value")).alias("value"))


def divergence(fields: DataFrame, depth: bool = True) -> DataFrame:
    """fields: (KEY, vx, vy, vz). The sum of the backward differences, so minus the usual divergence; the z term only
    with depth."""
    cubes, total = in_cubes(fields.select(*KEY, "vx", "vy", "vz"), before=True, after=False), F.lit(0.0)
    for a in AXES if depth else AXES[:2]:
        total = total + F.coalesce(F.lag(f"v{a}").over(_in_cube(a)), F.lit(0.0)) - F.col(f"v{a}")
    return cubes.select(*KEY, "own", total.alias("value")).where("own").drop("own")


def gradient(voxels: DataFrame) -> DataFrame:
    """(KEY, vx, vy, vz): forward differences."""
    return differences(voxels).select(*KEY, *(F.col(f"d{a}").alias(f"v{a}") for a in AXES))


def div_grad(voxels: DataFrame) -> DataFrame:
    """Minus the Laplacian with free borders: the sum of own - neighbour over the neighbours there are."""
    cubes, total = in_cubes(voxels.select(*KEY, "value"), before=True, after=True), F.lit(0.0)
    for a in AXES:
        for f in (F.lag, F.lead):
            total = total + F.coalesce(F.col("value") - f("value").over(_in_cube(a)), F.lit(0.0))
    return cubes.select(*KEY, "own", total.alias("value")).where("own").drop("own")


laplace = div_grad


def integrate_gradients(fields: DataFrame) -> DataFrame:
    """gx summed along x in the first row of the first slice, plus gy along y in the first slice, plus gz along z."""
    upto = lambda a: _line(a).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = lambda a: F.when(F.col(a) > 0, F.col(f"v{a}")).otherwise(0.0)
    along_z = fields.select(*KEY, F.sum(after("z")).over(upto("z")).alias("sz"))
    along_y = fields.where("z = 0").select("image_id", "x", "y", F.sum(after("y")).over(upto("y")).alias("sy"))
    along_x = fields.where("z = 0 and y = 0").select("image_id", "x", F.sum(after("x")).over(upto("x")).alias("sx"))
    return along_z.join(along_y, ["image_id", "x", "y"]).join(along_x, ["image_id", "x"]).select(*KEY, (F.col("sx") + F.col("sy") + F.col("sz")).alias("value"))


def line_profile(voxels: DataFrame, lines: DataFrame) -> DataFrame:
    """lines: (line_id, x1, y1, z1, x2, y2, z2) -> (image_id, line_id, pos, distance, value) along the digital line with
    both ends; a line of which an end is outside an image has no rows there. Lines with an image_id are only drawn there."""
    image = [c for c in ("image_id",) if c in lines.columns]
    n = F.greatest(*(F.abs(F.col(f"{a}2") - F.col(f"{a}1")) for a in AXES))
    steps = lines.withColumn("n", n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a: F.when(F.col("n") == 0, F.col(f"{a}1")).otherwise(F.floor(F.col(f"{a}1") + F.col("pos") * (F.col(f"{a}2") - F.col(f"{a}1")) / F.col("n") + 0.5)).cast("int").alias(a)
    steps = steps.select(*image, "line_id", "pos", "n", *map(at, AXES), "x1", "y1", "z1")
    far = F.sqrt(sum(((F.col(a) - F.col(f"{a}1")) * (F.col(a) - F.col(f"{a}1")) for a in AXES), F.lit(0)).cast("double"))
    met = voxels.join(steps, [*image, *AXES]).select("image_id", "line_id", "pos", "n", far.alias("distance"), "value")
    ends = F.sum(F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 1).otherwise(0)).over(Window.partitionBy("image_id", "line_id"))
    return met.withColumn("ends", ends).where("ends = 2 or n = 0").select("image_id", "line_id", "pos", "distance", "value")


def metric_total_variation(history: DataFrame) -> DataFrame:
    """history: (run, metric, t, value) -> the sum of |value[t + 1] - value[t]| without the last pair."""
    along = Window.partitionBy("run", "metric").orderBy("t")
    steps = history.select("run", "metric", F.abs(F.lead("value").over(along) - F.col("value")).alias("step"), F.lead("t", 2).over(along).alias("two"))
    return steps.groupBy("run", "metric").agg(F.sum(F.when(F.col("two").isNotNull(), F.col("step")).otherwise(0.0)).alias("tv"))
