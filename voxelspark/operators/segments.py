"""Region growing from seeds: floods inside tiles, joined over the faces of tiles.

A seed's flood is the part of its open voxels (no label yet, value below its tolerance) that holds the seed. Every tile
finds the parts of its own voxels; two neighbouring tiles meet by the labels of their touching faces, which give a graph
of parts; its components tell the parts that a seed reaches. Voxels stay in their tiles, and rows for the shuffles are
made for faces only.

Seeds come in order, and earlier regions block later ones. In one pass all seeds that are left flood at once; those that
meet no earlier seed that is left have their final region and are drawn, the others flood again in the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY, by_image, headers
from .durable import durable, forget
from .tiles import NAMES, TILE_SCHEMA, tile, untile

#: Bits for a part's number within its tile (its first voxel's place), and for a tile's place along an axis.
PART_BITS, TILE_BITS = 18, 15


def parts_of(inside: np.ndarray) -> np.ndarray:
    """For each voxel the smallest linear index of its 6-connected part of inside; outside, its own."""
    f, at = np.arange(inside.size), np.arange(inside.size).reshape(inside.shape)
    near, far = [], []
    for axis in range(inside.ndim):
        lo, hi = [slice(None)] * inside.ndim, [slice(None)] * inside.ndim
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        both = inside[tuple(lo)] & inside[tuple(hi)]
        near.append(at[tuple(lo)][both])
        far.append(at[tuple(hi)][both])
    a, b = np.concatenate(near), np.concatenate(far)
    while True:
        low, high = np.minimum(f[a], f[b]), np.maximum(f[a], f[b])
        apart = low < high
        if not apart.any():
            return f.reshape(inside.shape)
        np.minimum.at(f, high[apart], low[apart])
        while (g := f[f]).tobytes() != f.tobytes():
            f = g


def _plain(row) -> dict:
    return row if isinstance(row, dict) else row.asDict()


def _floods(t: dict) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(seed, open voxels, parts) for each seed of a tile row."""
    value, label = (np.frombuffer(f).reshape(t["d"], t["h"], t["w"]) for f in t["fields"])
    for seed in map(_plain, t["seeds"]):
        opened = (value < seed["tolerance"]) & (label == 0)
        if (own := _place(t, seed)) is not None:
            opened[own] = True
        yield seed, opened, parts_of(opened)


def _place(t: dict, seed: dict) -> tuple[int, int, int] | None:
    at = tuple(int(seed[a] - t[f"{a}0"]) for a in "zyx")
    return at if all(0 <= i < t[n] for i, n in zip(at, "dhw", strict=True)) else None


def _code(tx: int, ty: int, tz: int) -> int:
    return ((tz << TILE_BITS | ty) << TILE_BITS | tx) << PART_BITS


FACES = "image_id long, seed int, node long, axis int, tx int, ty int, tz int, parts binary"


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles with their seeds -> the part of each seed that is here (axis -1), and the open faces: numbers of parts, from
    1, under the tile on the lower side."""
    for frame in frames:
        rows = []
        for t in frame.to_dict("records"):
            code, at = _code(t["tx"], t["ty"], t["tz"]), [t["tx"], t["ty"], t["tz"]]
            for seed, opened, parts in _floods(t):
                if (own := _place(t, seed)) is not None:
                    rows.append([t["image_id"], seed["seed"], code | int(parts[own]), -1, *at, b""])
                numbers = np.where(opened, parts + 1, 0).astype(np.int32)
                for axis in range(3):
                    for side in (0, -1):
                        face = np.take(numbers, side, axis=2 - axis)
                        under = [p - (k == axis and side == 0) for k, p in enumerate(at)]
                        if under[axis] >= 0 and face.any():
                            rows.append([t["image_id"], seed["seed"], code, axis, *under, np.ascontiguousarray(face).tobytes()])
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACES.split(", ")])


def _touching(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both sides of a face -> pairs of parts that touch."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            sides = sorted(map(_plain, r.sides), key=lambda s: s["node"])
            a, b = (np.frombuffer(s["parts"], np.int32) for s in sides)
            both = (a > 0) & (b > 0)
            for i, j in np.unique(np.stack([a[both], b[both]], 1), axis=0).tolist():
                out.append([r.image_id, r.seed, sides[0]["node"] | (i - 1), sides[1]["node"] | (j - 1)])
        yield pd.DataFrame(out, columns=["image_id", "seed", "a", "b"])


def joined(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges: (keys, a, b) -> (keys, a, part): every end with the smallest number of its connected part.

    Labels take their neighbours' minimum, hand it to all that share their label, and then jump along labels, so a part
    of diameter d takes about log d rounds. Only the edges move, which are few beside the voxels; their files are small, so
    without hints Spark would send them through the driver in every round."""
    both = durable(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.select(*keys, "a").distinct().withColumn("part", F.col("a")))
    while True:
        near = both.join(labels.select(*keys, F.col("a").alias("b"), F.col("part").alias("other")).hint("merge"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("other").alias("near"))
        low = durable(labels.join(near.hint("merge"), [*keys, "a"]).select(*keys, "a", "part", F.least("part", "near").alias("low")))
        best = low.groupBy(*keys, "part").agg(F.min("low").alias("best"))
        hop = durable(low.join(best.hint("merge"), [*keys, "part"]).select(*keys, "a", "part", F.least("low", "best").alias("new")))
        far = hop.select(*keys, F.col("a").alias("new"), F.col("new").alias("far"))
        after = durable(hop.join(far.hint("merge"), [*keys, "new"]).select(*keys, "a", "part", F.least("new", "far").alias("new")))
        forget(labels, low, hop)
        if after.where("new <> part").isEmpty():
            forget(both)
            return after.select(*keys, "a", "part")
        labels = after.select(*keys, "a", F.col("new").alias("part"))
        labels.durable_path = after.durable_path


def _reached(tiles: DataFrame, active: DataFrame) -> DataFrame:
    """(image_id, seed, node): the parts that the flood of each active seed reaches, all seeds together."""
    faces = durable(_with_seeds(tiles, active).mapInPandas(_meet, FACES))
    sides = faces.where("axis >= 0").groupBy("image_id", "seed", "axis", "tx", "ty", "tz").agg(F.collect_list(F.struct("node", "parts")).alias("sides"))
    edges = durable(sides.where(F.size("sides") == 2).select("image_id", "seed", "sides").mapInPandas(_touching, "image_id long, seed int, a long, b long"))
    own = faces.where("axis = -1").select("image_id", "seed", "node")
    if edges.isEmpty():
        return own
    keys = ["image_id", "seed"]
    parts = joined(edges, keys)
    roots = own.join(parts.withColumnRenamed("a", "node").hint("merge"), [*keys, "node"], "left_outer").select(*keys, "node", "part")
    linked = parts.join(by_image(roots.where("part is not null").select(*keys, "part")), [*keys, "part"]).select(*keys, F.col("a").alias("node"))
    return durable(linked.unionByName(roots.where("part is null").select(*keys, "node")))


def _with_seeds(tiles: DataFrame, seeds: DataFrame) -> DataFrame:
    each = seeds.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seed", "segment_id", "x", "y", "z", "tolerance"))).alias("seeds"))
    return tiles.join(by_image(each), "image_id")


def _with_parts(tiles: DataFrame, seeds: DataFrame, reached: DataFrame, how: str) -> DataFrame:
    """Tiles with the seeds that reach them, and of each the parts. These grow with the tiles, so nothing is broadcast."""
    code = F.shiftleft(F.shiftright("node", PART_BITS), PART_BITS)
    rows = reached.join(by_image(seeds), ["image_id", "seed"]).withColumn("code", code)
    each = rows.groupBy("image_id", "code", "seed").agg(*(F.first(c).alias(c) for c in ("segment_id", "x", "y", "z", "tolerance")), F.collect_list((F.col("node") - F.col("code")).cast("int")).alias("parts"))
    lists = each.groupBy("image_id", "code").agg(F.sort_array(F.collect_list(F.struct("seed", "segment_id", "x", "y", "z", "tolerance", "parts"))).alias("seeds"))
    place = F.shiftleft(F.shiftleft(F.shiftleft(F.col("tz").cast("long"), TILE_BITS) + F.col("ty"), TILE_BITS) + F.col("tx"), PART_BITS)
    return tiles.withColumn("code", place).join(lists.hint("merge"), ["image_id", "code"], how).drop("code")


def _clashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(image_id, seed): seeds whose flood meets that of an earlier one in this tile."""
    for frame in frames:
        rows = set()
        for t in frame.to_dict("records"):
            taken = np.zeros((t["d"], t["h"], t["w"]), bool)
            for seed, opened, parts in _floods(t):
                own = opened & np.isin(parts, seed["parts"])
                if (own & taken).any():
                    rows.add((t["image_id"], seed["seed"]))
                taken |= own
        yield pd.DataFrame(sorted(rows), columns=["image_id", "seed"])


def _drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for t in frame.to_dict("records"):
            if t["seeds"] is not None:
                label = np.frombuffer(t["fields"][1]).reshape(t["d"], t["h"], t["w"]).copy()
                for seed, opened, parts in _floods(t):
                    label[opened & np.isin(parts, seed["parts"])] = seed["segment_id"]
                t["fields"] = [t["fields"][0], label.tobytes()]
            rows.append([t[c] for c in NAMES])
        yield pd.DataFrame(rows, columns=NAMES)


def region_grow(voxels: DataFrame, seeds: DataFrame, size: int = 64) -> DataFrame:
    """seeds: (segment_id, seed_no, x, y, z, tolerance), for all images, or with an image_id for one each -> (KEY, label,
    edge).

    Segments grow in order, each through voxels that have no label yet and a value below the seed's tolerance; a seed
    always has its label; one outside its image is left out. edge: in a flat image, a grown voxel with a z-neighbour that
    is outside or not labelled. Seeds of an image are few: they travel with its tiles."""
    if size**3 > 1 << PART_BITS:
        raise ValueError("tiles of 64 voxels an axis at most")
    images = durable(headers(voxels))
    tiles = durable(tile(voxels.withColumn("label", F.lit(0.0)), ("value", "label"), size))
    order = Window.partitionBy(*(c for c in ("image_id",) if c in seeds.columns)).orderBy("segment_id", "seed_no")
    numbered = seeds.withColumn("seed", F.row_number().over(order))
    sized = images.select("image_id", "width", "height", "depth")
    placed = numbered.join(sized, "image_id") if "image_id" in seeds.columns else sized.join(F.broadcast(numbered), F.lit(True))
    active = placed.where("x between 0 and width - 1 and y between 0 and height - 1 and z between 0 and depth - 1")
    active = durable(active.select("image_id", "seed", "segment_id", "x", "y", "z", "tolerance"))
    while not active.isEmpty():
        reached = _reached(tiles, active)
        late = durable(_with_parts(tiles, active, reached, "inner").mapInPandas(_clashes, "image_id long, seed int").distinct())
        ready, left = (active.join(by_image(late), ["image_id", "seed"], how) for how in ("left_anti", "left_semi"))
        left = durable(left)
        after = durable(_with_parts(tiles, ready, reached, "left").mapInPandas(_drawn, TILE_SCHEMA))
        forget(tiles, reached, late, active)
        tiles, active = after, left
    marked = untile(tiles, {"label": 1}).join(by_image(images.select("image_id", "depth")), "image_id")
    return marked.select(*KEY, F.col("label").cast("int").alias("label"), ((F.col("label") > 0) & (F.col("depth") == 1)).alias("edge"))
