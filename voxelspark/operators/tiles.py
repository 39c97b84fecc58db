"""Blocks of voxels for work that needs whole neighbourhoods: small images whole, large ones in tiles with halos.

A tile row holds its fields as binary float64 arrays, and the numbers that its image is worked on with (params). To advance by `halo` cells every tile sends itself and the slabs
that its neighbours need; a task assembles one padded block, works on it as if it were an image, and keeps the inner
part. An update of radius 1 spoils one layer of a padded border a step, so `halo` steps are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY
from .durable import durable, forget

TILE = 64
TILE_SCHEMA = "image_id long, tx int, ty int, tz int, x0 int, y0 int, z0 int, w int, h int, d int, fields array<binary>, params array<double>"
NAMES = [c.split()[0] for c in TILE_SCHEMA.split(", ")]
#: Fields and params of a block -> its new fields.
Step = Callable[[list[np.ndarray], tuple[float, ...]], list[np.ndarray]]
#: Image ids (8 bytes each) up to which those that are done are broadcast.
BROADCAST_IDS = 1_000_000
#: Tiles that a Python worker is handed at a time. A tile of 64 x 64 with the dozen fields of a solver has 400 kB, one of
#: 64^3 over 30 MB, and several times that on its way to its neighbours.
TILES = 8


@contextmanager
def few_tiles(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs hand TILES rows at most to Python at a time, and not the thousands of Arrow's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(TILES, int(before)) if int(before) > 0 else TILES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(tiles: DataFrame) -> DataFrame:
    """durable, of what is made of tiles."""
    with few_tiles(tiles.sparkSession):
        return durable(tiles)


def tile(voxels: DataFrame, columns: tuple[str, ...] = ("value",), size: int = TILE, params: DataFrame | None = None) -> DataFrame:
    """Tiles of at most size voxels an axis, with the given columns as fields. params: (image_id, params)."""
    key = ["image_id", "tx", "ty", "tz"]
    at = voxels.select("image_id", *(F.floor(F.col(a) / size).cast("int").alias(f"t{a}") for a in "xyz"), F.struct("z", "y", "x", *columns).alias("c"))
    lists = at.groupBy(*key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    lists = lists.withColumn("params", F.array().cast("array<double>")) if params is None else lists.join(params, "image_id")
    flat = lists.select(*key, "params", *(F.col(f"c.{a}").alias(a) for a in ("x", "y", "z")), *(F.col(f"c.{v}").alias(f"_{v}") for v in columns))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                ends = [(int(r[a][0]), int(r[a][-1])) for a in ("x", "y", "z")]
                fields = [np.asarray(r[f"_{v}"], np.float64).tobytes() for v in columns]
                rows.append([r["image_id"], r["tx"], r["ty"], r["tz"], *(lo for lo, _ in ends), *(hi - lo + 1 for lo, hi in ends), fields, r["params"]])
            yield pd.DataFrame(rows, columns=NAMES)

    return flat.mapInPandas(build, TILE_SCHEMA)


def untile(tiles: DataFrame, fields: dict[str, int]) -> DataFrame:
    """(KEY, one column for each field: name -> place in fields)."""
    schema = ", ".join(["image_id long", "x int", "y int", "z int", *(f"{n} double" for n in fields)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                z, y, x = np.meshgrid(np.arange(t.d), np.arange(t.h), np.arange(t.w), indexing="ij")
                cols = {"image_id": t.image_id, "x": (x + t.x0).ravel().astype(np.int32), "y": (y + t.y0).ravel().astype(np.int32), "z": (z + t.z0).ravel().astype(np.int32)}
                yield pd.DataFrame(cols | {n: np.frombuffer(t.fields[i]) for n, i in fields.items()})

    return tiles.mapInPandas(run, schema)


def within(tiles: DataFrame, step: Step) -> DataFrame:
    """step on every tile by itself: for images of one tile, and for steps that look at no neighbour."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["fields"] = [[np.ascontiguousarray(a).tobytes() for a in step([np.frombuffer(f).reshape(t.d, t.h, t.w) for f in t.fields], tuple(t.params))] for t in frame.itertuples()]
            yield frame

    return tiles.mapInPandas(run, TILE_SCHEMA)


def advance(tiles: DataFrame, halo: int, step: Step, size: int = TILE) -> DataFrame:
    """step on every padded block; its fields, of any new number, replace the tile's."""
    assert halo <= size

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame.itertuples():
                arrays = [np.frombuffer(f).reshape(t.d, t.h, t.w) for f in t.fields]
                for dz in (-1, 0, 1):
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            cut, at, shape = [], [], []
                            for delta, n, start in ((dz, t.d, t.z0), (dy, t.h, t.y0), (dx, t.w, t.x0)):
                                lo, hi = (0, n) if delta == 0 else (max(0, n - halo), n) if delta > 0 else (0, min(halo, n))
                                cut.append(slice(lo, hi))
                                at.append(start + lo)
                                shape.append(hi - lo)
                            to = (t.tx + dx, t.ty + dy, t.tz + dz)
                            if min(to) >= 0 and min(shape) > 0:
                                out.append([t.image_id, *to, at[2], at[1], at[0], shape[2], shape[1], shape[0], [np.ascontiguousarray(a[tuple(cut)]).tobytes() for a in arrays], t.params, dx == dy == dz == 0])
            yield pd.DataFrame(out, columns=[*NAMES, "own"])

    def assemble(parts: list[dict]) -> list | None:
        own = next((p for p in parts if p["own"]), None)
        if own is None:  # no such tile: the image ends before it
            return None
        lo = [min(p[c] for p in parts) for c in ("z0", "y0", "x0")]
        hi = [max(p[c] + p[n] for p in parts) for c, n in (("z0", "d"), ("y0", "h"), ("x0", "w"))]
        blocks = [np.zeros([b - a for a, b in zip(lo, hi, strict=True)]) for _ in own["fields"]]
        at = lambda p: tuple(slice(p[c] - a, p[c] - a + p[n]) for a, c, n in zip(lo, ("z0", "y0", "x0"), ("d", "h", "w"), strict=True))
        for p in parts:
            for block, f in zip(blocks, p["fields"], strict=True):
                block[at(p)] = np.frombuffer(f).reshape(p["d"], p["h"], p["w"])
        return [np.ascontiguousarray(f[at(own)]).tobytes() for f in step(blocks, tuple(own["params"]))]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                parts = [p if isinstance(p, dict) else p.asDict() for p in r["parts"]]
                if (fields := assemble(parts)) is not None:
                    own = next(p for p in parts if p["own"])
                    rows.append([r["image_id"], r["tx"], r["ty"], r["tz"], *(own[c] for c in ("x0", "y0", "z0", "w", "h", "d")), fields, own["params"]])
            yield pd.DataFrame(rows, columns=NAMES)

    sent = tiles.mapInPandas(send, TILE_SCHEMA + ", own boolean")
    parts = F.struct("x0", "y0", "z0", "w", "h", "d", "fields", "params", "own")
    return sent.groupBy("image_id", "tx", "ty", "tz").agg(F.collect_list(parts).alias("parts")).mapInPandas(work, TILE_SCHEMA)


def by_blocks(voxels: DataFrame, f: Callable[[np.ndarray], np.ndarray], halo: int, size: int = TILE) -> DataFrame:
    """f of the whole image, by blocks; f reads at most halo - 1 voxels around each."""
    return untile(advance(tile(voxels, size=size), halo, lambda fields, _: [f(fields[0])], size), {"value": 0}).select(*KEY, "value")


def some(tiles: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """tiles of the images in ids (left_semi), or of all others (left_anti)."""
    return tiles.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "image_id", how)


def iterate_tiles(
    tiles: DataFrame,
    start: Step,
    step: Step,
    iterations: int,
    halo: int = 8,
    size: int = TILE,
    alone: bool = False,
    checks: list[int] | None = None,
    at_check: Callable[[int, DataFrame], DataFrame | None] | None = None,
) -> DataFrame:
    """`iterations` steps of radius 1, `halo` of them with each exchange; the state is written out after every exchange,
    and the one before it is deleted. alone: every image is one tile, so nothing is exchanged.

    start makes the state from the input fields, without looking at neighbours. After each number of steps in checks,
    at_check gets that number and the states of the images that still run, and may return the ids of those that are done:
    these keep their state and leave the exchange, before any further step. It must not keep unwritten results of the
    states that it is given. All images end with their last state."""

    def many(n: int) -> Step:
        def run(fields: list[np.ndarray], params: tuple[float, ...]) -> list[np.ndarray]:
            for _ in range(n):
                fields = step(fields, params)
            return fields

        return run

    state = within(tiles, start)
    done, finished = 0, []
    stops = sorted(c for c in {*(checks or []), iterations} if c <= iterations)
    for upto in stops:
        while done < upto:
            n = upto - done if alone else min(halo, upto - done)
            after = kept(within(state, many(n)) if alone else advance(state, n, many(n), size))
            forget(state)
            state, done = after, done + n
        gone = at_check(upto, state) if at_check and upto in (checks or []) else None
        if gone is not None:
            gone = durable(gone.select("image_id").distinct())
            if not gone.isEmpty():
                finished.append(durable(some(state, gone, "left_semi")))
                after = durable(some(state, gone, "left_anti"))
                forget(state)
                state = after
                if state.isEmpty():
                    break
    for part in finished:
        state = state.unionByName(part)
    return state
