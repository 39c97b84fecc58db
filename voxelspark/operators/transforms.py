"""Cosine transforms, Poisson equations and resampling. Each axis is one shuffle: of voxels to the rows of their lines for
the transforms, with partial sums for the others."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import spline_coefficients
from ..model import AXES, KEY, SIZE, by_image, headers
from .durable import durable, forget
from .lines import along
from .windows import divergence


#: Values of lines that are transformed together in a task.
STACK = 1 << 20


def dct_lines(v: np.ndarray) -> np.ndarray:
    """DCT-II of each row, from the Fourier transform of the row and its mirror image: sum of v[i] cos(pi (i + 1/2) k / n)."""
    n = v.shape[1]
    mirrored = np.fft.rfft(np.concatenate([v, v[:, ::-1]], axis=1), axis=1)[:, :n]
    return (mirrored * np.exp(-0.5j * np.pi * np.arange(n) / n)).real / 2


def idct_lines(c: np.ndarray) -> np.ndarray:
    """The inverse of dct_lines."""
    n = c.shape[1]
    half = np.zeros((len(c), n + 1), complex)
    half[:, :n] = 2 * c * np.exp(0.5j * np.pi * np.arange(n) / n)
    return np.fft.irfft(half, 2 * n, axis=1)[:, :n]


def _axis(voxels: DataFrame, images: DataFrame, axis: str, transform) -> DataFrame:
    """transform(rows of a matrix) of each line along one axis, by one shuffle of voxels to the rows of their lines. Voxels
    that are missing or null count as 0; those outside the image are dropped."""
    rest = [c for c in KEY if c != axis]
    sized = voxels.join(images.select("image_id", F.col(SIZE[axis]).alias("n")), "image_id").where((F.col(axis) >= 0) & (F.col(axis) < F.col("n")))
    points = F.collect_list(F.struct(F.col(axis).alias("at"), F.coalesce("value", F.lit(0.0)).alias("v")))
    lines = sized.groupBy(*rest, "n").agg(points.alias("line")).select(*rest, "n", F.col("line.at").alias("at"), F.col("line.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("n").to_numpy()
            for n in np.unique(length).tolist():
                rows, some = np.flatnonzero(length == n), max(1, STACK // n)
                for part in (batch.take(pa.array(rows[i : i + some])) for i in range(0, len(rows), some)):
                    at, v = part.column("at"), part.column("v")
                    dense = np.zeros((part.num_rows, n))
                    row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                    np.add.at(dense, (row, at.flatten().to_numpy()), v.flatten().to_numpy())
                    out = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * np.int32(n)), pa.array(transform(dense).ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), out], names=[*rest, "v"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in lines.schema if f.name in rest] + ["v array<double>"])
    return lines.mapInArrow(run, schema).select(*rest, F.posexplode("v").alias(axis, "value")).select(*KEY, "value")


def dct(voxels: DataFrame, images: DataFrame | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """8 times the separable DCT-II, not normalised. axes: those along which some image has more than one voxel; the others
    stay as they are."""
    images = headers(voxels) if images is None else images
    out = voxels
    for a in axes:
        out = _axis(out, images, a, dct_lines)
    return out.select(*KEY, (F.col("value") * 8).alias("value"))


def idct(coefficients: DataFrame, images: DataFrame | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """The inverse of dct."""
    images = headers(coefficients) if images is None else images
    out = coefficients
    for a in reversed(axes):
        out = _axis(out, images, a, idct_lines)
    return out.select(*KEY, (F.col("value") / 8).alias("value"))


def poisson_cosine(coefficients: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Coefficients divided by the eigenvalues of div_grad; the zero frequency becomes 0."""
    images = headers(coefficients) if images is None else images
    sized = coefficients.join(images.select("image_id", *SIZE.values()), "image_id")
    eigen = sum((2 - 2 * F.cos(F.lit(math.pi) * F.col(a) / F.col(n)) for a, n in SIZE.items()), F.lit(0.0))
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return sized.select(*KEY, F.when(zero, 0.0).otherwise(F.col("value") / eigen).alias("value"))


def solve_poisson(f: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """u with div_grad(u) = f - mean(f) and mean 0. Axes of one voxel are not moved along, nor is an axis twice in a row."""
    images = durable(headers(f) if images is None else images)
    most = images.agg(*(F.max(n).alias(a) for a, n in SIZE.items())).first()
    axes = tuple(a for a in AXES if (most[a] or 0) > 1) or AXES[:1]
    return idct(poisson_cosine(dct(f, images, axes), images), images, axes)


def remove_zero_frequency(voxels: DataFrame) -> DataFrame:
    """Without the zero frequency, an image is what it was less its mean."""
    mean = voxels.groupBy("image_id").agg(F.avg("value").alias("mean"))
    return voxels.join(mean, "image_id").select(*KEY, (F.col("value") - F.col("mean")).alias("value"))


def integrate_gradients_poisson(fields: DataFrame) -> DataFrame:
    return solve_poisson(divergence(fields))


def _cubic(t: np.ndarray, a: float) -> np.ndarray:
    d = np.abs(t)
    return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0.0))


def _sinc(t: np.ndarray, radius: int) -> np.ndarray:
    p = np.pi * np.where(np.abs(t) < 1e-12, 1.0, t)
    return np.where(np.abs(t) < 1e-12, 1.0, np.where(np.abs(t) >= radius, 0.0, np.sin(p) / p * np.sin(p / radius) / (p / radius)))


#: Taps from the old voxel at or before a new one's place.
REACH_OF = {"nearest": (0, 0), "linear": (0, 1), "area": (0, 1), "cubic": (-1, 2), "bspline3": (-1, 2), "sinc": (-3, 4)}


def _resize_taps(method: str, n: int, m: int, pad: float, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Old places and weights (new voxels, taps) of the new voxels at `to`."""
    at = (to + 0.5) * n / m - 0.5 if method == "cubic" else to * n / (m + pad)
    base = np.floor(at + 0.5) if method == "nearest" else np.floor(at)
    first, last = REACH_OF[method]
    i = base[:, None] + np.arange(first, last + 1)
    t = at[:, None] - i
    d = np.abs(t)
    if method == "nearest":
        w = np.ones_like(t)
    elif method == "linear":
        w = 1 - d
    elif method == "area":
        over = (to + 1) - (base + 1) * m / n  # of the new voxel, what lies past the old one
        share = np.where(over <= 0, 0.0, over - np.floor(over))
        w = np.stack([1 - share, share], 1)
    elif method == "cubic":
        w = _cubic(t, -0.75)
    elif method == "bspline3":
        w = np.where(d < 1, 2 / 3 - d * d + d * d * d / 2, np.where(d < 2, (2 - d) * (2 - d) * (2 - d) / 6, 0.0))
    else:
        w = _sinc(t, 4)
    # Mirror for splines, whose prefilter mirrors; repeat the end for the others.
    mirrored = n - 1 - np.abs(n - 1 - np.abs(i))
    return np.clip(mirrored if method == "bspline3" else i, 0, n - 1).astype(int), w


def resize_axis(voxels: DataFrame, images: DataFrame, axis: str, new: Column, method: str, pad: Column) -> DataFrame:
    """Places new voxels of one axis at i * n / (new + pad); taps beyond the ends repeat the end; weights sum to 1. cubic
    and area count from voxel centres: cubic takes four taps, area (for larger images) repeats a voxel and blends where a
    new voxel spans two."""
    sizes = images.select("image_id", F.col(SIZE[axis]).alias("n"), new.cast("int").alias("m"), pad.cast("double").alias("pad"))
    source = _prefilter(voxels, axis) if method == "bspline3" else voxels
    scale = "m / n" if method == "cubic" else "(m + pad) / n"
    return along(source, sizes, axis, lambda n, m, own, to: _resize_taps(method, n, m, own[0], to), 4, ("pad",), scale, normalised=True)


#: Values of a line that are filtered together, and beyond these on both sides: what is further away weighs under 1e-22.
SEGMENT, REACH = 1 << 16, 40


def _prefilter(voxels: DataFrame, axis: str, segment: int = SEGMENT) -> DataFrame:
    """Cubic B-spline coefficients along one axis with mirrored ends: the line's values solve a banded system, whose
    inverse falls by 0.268 a voxel. So a line goes to segments with REACH more voxels on both sides, one row each."""
    rest = [c for c in KEY if c != axis]
    own = F.floor(F.col(axis) / segment)
    near = F.array_distinct(F.array(F.floor((F.col(axis) - REACH) / segment), own, F.floor((F.col(axis) + REACH) / segment)))
    dealt = voxels.select(*KEY, "value", F.explode(F.filter(near, lambda k: k >= 0)).alias("part"))
    lines = dealt.groupBy(*rest, "part").agg(F.array_sort(F.collect_list(F.struct(axis, "value"))).alias("line"))
    lines = lines.select(*rest, "part", F.col(f"line.{axis}").alias("at"), F.col("line.value").alias("v"))
    schema = ", ".join([f"{c} {'long' if c == 'image_id' else 'int'}" for c in rest] + ["part long", "at array<int>", "v array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, at, v in zip(frame["part"], frame["at"], frame["v"], strict=True):
                at, own = np.asarray(at), np.asarray(at) // segment == part
                out.append((at[own].tolist(), spline_coefficients(np.array(v, float))[own].tolist()))
            yield frame.assign(at=[a for a, _ in out], v=[v for _, v in out])

    done = lines.mapInPandas(run, schema).select(*rest, F.explode(F.arrays_zip("at", "v")).alias("c"))
    return done.select(*rest, F.col("c.at").alias(axis), F.col("c.v").alias("value")).select(*KEY, "value")


#: Voxels that an enlarged grid has more an axis, before it is cropped again.
PAD = 2


def _resize(voxels: DataFrame, images: DataFrame, new: dict[str, Column], method: str, pad: int | None) -> DataFrame:
    grows = F.lit(False)
    for a, n in SIZE.items():
        grows = grows | (new[a] > F.col(n))
    extra = F.when(grows, PAD).otherwise(0) if pad is None else F.lit(pad)
    sizes = durable(images.select("image_id", *SIZE.values(), *(new[a].cast("int").alias(f"to_{a}") for a in SIZE), extra.alias("pad")))
    most = sizes.agg(*(F.max(F.greatest(n, f"to_{a}")).alias(a) for a, n in SIZE.items())).first()
    out = voxels
    if all(most[a] == 1 for a in SIZE):
        out = voxels.join(by_image(sizes.select("image_id")), "image_id", "left_semi")
    for a in SIZE:
        if most[a] != 1:  # else an axis of one voxel that stays one
            out = resize_axis(out, sizes, a, F.col(f"to_{a}"), method, F.col("pad"))
    return out.select(*KEY, "value")


def resize(voxels: DataFrame, factor: float, method: str = "linear", images: DataFrame | None = None, pad: int | None = None) -> DataFrame:
    """Sizes become ceil(n * factor), at least 1, axis by axis; an axis of one voxel stays. An image of which an axis
    grows is placed on a grid that is PAD voxels wider on every axis and cropped; pad, if given, is that number for all."""
    images = headers(voxels) if images is None else images
    new = {a: F.when(F.col(n) == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col(n) * factor))) for a, n in SIZE.items()}
    return _resize(voxels, images, new, method, pad)


def resize_to(voxels: DataFrame, width: int, height: int, depth: int, method: str = "linear", images: DataFrame | None = None, pad: int | None = None) -> DataFrame:
    """To the sizes given; pad as in resize."""
    images = headers(voxels) if images is None else images
    return _resize(voxels, images, {a: F.lit(m) for a, m in zip(AXES, (width, height, depth), strict=True)}, method, pad)


def resize_like(voxels: DataFrame, like: DataFrame, method: str = "linear", images: DataFrame | None = None) -> DataFrame:
    """Each image to its size in like, a table of headers; images that it lacks are dropped."""
    sizes = like.select("image_id", *(F.col(n).alias(f"new_{n}") for n in SIZE.values()))
    images = (headers(voxels) if images is None else images).join(sizes, "image_id")
    return _resize(voxels, images, {a: F.col(f"new_{n}") for a, n in SIZE.items()}, method, None)


def resize_auto(voxels: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """Volumes: linear. Flat images, each by its own width: area if it grows, else cubic, both from voxel centres."""
    images = durable(headers(voxels))
    volumes, flat = images.where("depth > 1"), images.where("depth = 1")
    enlarged, reduced = flat.where(F.col("width") < width), flat.where(F.col("width") >= width)
    out = resize_to(voxels, width, height, depth, "linear", volumes)
    out = out.unionByName(resize_to(voxels, width, height, 1, "area", enlarged, pad=0))
    return out.unionByName(resize_to(voxels, width, height, 1, "cubic", reduced, pad=0))


def resized_header(images: DataFrame, factor: float, pad: int | None = None) -> DataFrame:
    """Headers of what resize gives: the physical size stays, so spacings become spacing * n / new, with the wider grid's
    size for new where the image grows; the origin stays."""
    new = {a: F.when(F.col(n) == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col(n) * factor))).cast("int") for a, n in SIZE.items()}
    grows = F.lit(False)
    for a, n in SIZE.items():
        grows = grows | (new[a] > F.col(n))
    extra = F.when(grows, PAD).otherwise(0) if pad is None else F.lit(pad)
    spacing = {f"s{a}": F.col(f"s{a}") * F.col(n) / (new[a] + extra) for a, n in SIZE.items()}
    return images.withColumns(spacing | {n: new[a] for a, n in SIZE.items()})


def shrink(voxels: DataFrame, fx: int, fy: int, fz: int = 1, images: DataFrame | None = None) -> DataFrame:
    """Every f-th voxel, from floor(f / 2) on, or the last one; sizes floor(n / f), at least 1."""
    images = headers(voxels) if images is None else images
    out = voxels.join(images.select("image_id", *SIZE.values()), "image_id")
    for (a, n), f in zip(SIZE.items(), (fx, fy, fz), strict=True):
        size = F.greatest(F.lit(1), F.floor(F.col(n) / f))
        first = F.least(F.lit(f // 2), F.col(n) - 1)
        out = out.withColumn("at", F.col(a) - first).where((F.col("at") >= 0) & (F.col("at") % f == 0) & (F.col("at") / f < size)).withColumn(a, (F.col("at") / f).cast("int"))
    return out.select(*KEY, "value")


def basis(t: np.ndarray | Column, order: int) -> list:
    """The uniform B-splines of an order that are not 0 on a span, at t from its start: polynomials by their recursion over
    orders, ((t + d - k) * b[k - 1] + (k + 1 - t) * b[k]) / d for order d, each written as one nested product."""
    b = [[Fraction(1)]]  # coefficients from the constant up
    for d in range(1, order + 1):
        below, b = [[Fraction(0)] * d, *b, [Fraction(0)] * d], []
        for k in range(d + 1):
            left, right = below[k], below[k + 1]
            constant = [(d - k) * x + (k + 1) * y for x, y in zip(left, right, strict=True)]
            linear = [x - y for x, y in zip(left, right, strict=True)]
            b.append([(x + y) / d for x, y in zip([*constant, 0], [0, *linear], strict=True)])

    def nested(coefficients: list[Fraction]):
        out = t * 0 + float(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * t + float(c)
        return out

    return [nested(p) for p in b]


POINT = ["image_id", "cx", "cy", "cz"]


#: Voxels an axis of the bricks that fields are fitted and evaluated in, and doubles of lattices, and of weights of voxels,
#: in a task at a time (one brick at least).
BRICK, LATTICES, WEIGHTS = 64, 1 << 22, 1 << 21
BRICK_SCHEMA = "image_id long, width int, height int, depth int, x array<int>, y array<int>, z array<int>, value array<double>"


def _bricks(rows: DataFrame) -> DataFrame:
    """Rows (KEY, value) with sizes as rows of up to BRICK^3 voxels of an image, which need not be all there."""
    sizes = list(SIZE.values())
    at = rows.select("image_id", *sizes, *(F.floor(F.col(a) / BRICK).alias(f"b{a}") for a in AXES), F.struct(*AXES, F.col("value").cast("double").alias("value")).alias("p"))
    lists = at.groupBy("image_id", *sizes, "bx", "by", "bz").agg(F.collect_list("p").alias("p"))
    return lists.select("image_id", *(F.col(n).cast("int").alias(n) for n in sizes), *(F.col(f"p.{a}").alias(a) for a in (*AXES, "value")))


class _Taps:
    """Places of the control points of voxels and their weights, tap by tap: made anew each time, as a voxel may have
    hundreds. axes: of each axis, the first places and the weights that follow each other from there."""

    def __init__(self, axes: list[tuple[np.ndarray, list[np.ndarray], int]]) -> None:
        self.axes = axes

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (x, wx, sx), (y, wy, sy), (z, wz, sz) = self.axes
        for i, a in enumerate(wx):
            for j, b in enumerate(wy):
                ab, at = a * b, sx * (x + i) + sy * (y + j)
                for k, c in enumerate(wz):
                    yield at + sz * (z + k), ab * c


def _parts_of(batch: pa.RecordBatch, across: int, order: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of bricks as many at a time as LATTICES and WEIGHTS allow."""
    three = max([2, *((batch.column("depth").to_numpy() > 1) + 2)])
    some = max(1, LATTICES // across ** int(three))
    ends = np.cumsum(np.diff(batch.column("x").offsets.to_numpy())) * 3 * (order + 2)
    i = 0
    while i < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WEIGHTS, side="right"))
        j = max(i + 1, min(fits, i + some))
        yield batch.slice(i, j - i)
        i = j


def _on_bricks(bricks: DataFrame, spans: int, order: int, work: Callable, schema: str) -> DataFrame:
    """work(batch, row of each voxel, its taps, sum of all squares) on batches of bricks. Places are those of _place."""
    across = spans + order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = across ** int(max([2, *((batch.column("depth").to_numpy() > 1) + 2)]))
            for part in _parts_of(batch, across, order):
                part = part.take(pa.array(np.arange(part.num_rows)))  # offsets from 0
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column("x").offsets.to_numpy()))
                axes, squares = [], np.ones(len(row))
                for a, stride in zip(AXES, (1, across, across**2), strict=True):
                    n = part.column(SIZE[a]).to_numpy()[row]
                    at = np.where(n > 1, part.column(a).flatten().to_numpy() * float(spans) / np.maximum(n - 1, 1), 0.0)
                    cell = np.minimum(np.floor(at), spans - 1)
                    b = [np.where(n > 1, w, float(k == 0)) for k, w in enumerate(basis(at - cell, order))]
                    squares = squares * sum(w * w for w in b)
                    held = order + 1 if (n > 1).any() else 1
                    axes.append((np.where(n > 1, cell, 0).astype(np.int64), b[:held], np.where(n > 1, stride, 0)))
                yield from work(part, row, _Taps(axes), squares, most)

    return bricks.mapInArrow(run, schema)


def _lattice(bricks: DataFrame, spans: int, order: int) -> DataFrame:
    """(POINT, c) from the voxels of bricks: sums of a brick are made in its task."""
    across = spans + order

    def work(part: pa.RecordBatch, row: np.ndarray, taps: _Taps, squares: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        told = part.column("value").flatten()
        value = told.fill_null(0.0).to_numpy()
        up, down, told = np.zeros(part.num_rows * most), np.zeros(part.num_rows * most), ~told.is_null().to_numpy(zero_copy_only=False)
        known = np.zeros(part.num_rows * most)
        for i, w in taps:
            at = row * most + i
            up += np.bincount(at, w**3 * value / squares, len(up))
            down += np.bincount(at, w * w, len(up))
            known += np.bincount(at, (w > 0) & told, len(up))
        at = np.flatnonzero(down > 0)
        place = at % most
        ids = part.column("image_id").take(pa.array(at // most))
        points = [pa.array((place // s % across).astype(np.int64)) for s in (1, across, across**2)]
        yield pa.RecordBatch.from_arrays([ids, *points, pa.array(up[at], mask=~(known[at] > 0)), pa.array(down[at])], names=[*POINT, "up", "down"])

    sums = _on_bricks(bricks, spans, order, work, "image_id long, cx long, cy long, cz long, up double, down double")
    return sums.groupBy(*POINT).agg((F.sum("up") / F.sum("down")).alias("c"))


def _with_lattice(bricks: DataFrame, lattice: DataFrame, spans: int, order: int) -> DataFrame:
    """Bricks with the control points of their image, one row an image; these are broadcast up to MOST_POINTS."""
    across = spans + order
    place = (F.col("cx") + F.col("cy") * across + F.col("cz") * across**2).cast("long")
    lists = lattice.groupBy("image_id").agg(F.collect_list(F.struct(place.alias("i"), "c")).alias("points"))
    lists = lists.select("image_id", F.col("points.i").alias("places"), F.col("points.c").alias("c"))
    empty = (F.coalesce("places", F.array().cast("array<long>")).alias("places"), F.coalesce("c", F.array().cast("array<double>")).alias("c"))
    few = F.broadcast(lists) if lattice.count() <= MOST_POINTS else lists.hint("merge")
    return bricks.join(few, "image_id", "left").select(*bricks.columns, *empty)


def _fitted(bricks: DataFrame, lattice: DataFrame, spans: int, order: int, left: bool = False) -> DataFrame:
    """Bricks with the field as values, or, with left, with what it leaves of their values."""

    def work(part: pa.RecordBatch, row: np.ndarray, taps: _Taps, squares: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        places = part.column("places")
        dense = np.zeros((part.num_rows, most))
        dense[np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = part.column("c").flatten().fill_null(0.0).to_numpy()
        fit = sum(w * dense[row, i] for i, w in taps)
        value, mask = fit, None
        if left:
            before = part.column("value").flatten()
            value, mask = before.fill_null(0.0).to_numpy() - fit, before.is_null().to_numpy(zero_copy_only=False)
        new = pa.ListArray.from_arrays(part.column("value").offsets, pa.array(value, mask=mask))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("image_id", *SIZE.values(), *AXES)), new], names=["image_id", *SIZE.values(), *AXES, "value"])

    return _on_bricks(_with_lattice(bricks, lattice, spans, order), spans, order, work, BRICK_SCHEMA)


def _evaluated(rows: DataFrame, lattice: DataFrame, spans: int, order: int) -> DataFrame:
    """(KEY, fit) of rows with sizes."""
    done = _fitted(_bricks(rows.withColumn("value", F.lit(0.0))), lattice, spans, order)
    return done.select("image_id", F.explode(F.arrays_zip(*AXES, "value")).alias("p")).select("image_id", *(F.col(f"p.{a}").alias(a) for a in AXES), F.col("p.value").alias("fit"))


def _refined(lattice: DataFrame, images: DataFrame, spans: int, order: int) -> DataFrame:
    """The same field on twice the spans: a spline is a sum of splines of half the width, with binomial weights."""
    out = lattice.join(by_image(images.select("image_id", *SIZE.values())), "image_id")
    for a, n in SIZE.items():
        halves = F.array(*(F.struct((2 * F.col(f"c{a}") - order + k).alias("to"), F.lit(math.comb(order + 1, k) / 2.0**order).alias("h")) for k in range(order + 2)))
        one = F.array(F.struct(F.col(f"c{a}").alias("to"), F.lit(1.0).alias("h")))
        out = out.withColumn("s", F.explode(F.when(F.col(n) > 1, halves).otherwise(one)))
        inside = F.col("s.to").between(0, F.when(F.col(n) > 1, 2 * spans + order - 1).otherwise(0))
        out = out.where(inside).withColumns({"c": F.col("c") * F.col("s.h"), f"c{a}": F.col("s.to")}).drop("s")
    return out.groupBy(*POINT).agg(F.sum("c").alias("c"))


#: Control points (40 bytes each) up to which lattices are broadcast.
MOST_POINTS = 200_000


def bspline_fit(voxels: DataFrame, mask: DataFrame | None, nodes: int, levels: int = 1, order: int = 3) -> DataFrame:
    """A smooth field fitted to the voxels inside the mask by multilevel B-spline approximation, on the full grid; 0 where
    no voxel inside is near.

    Every voxel adds to the control points that it touches: sums of w^2 * phi and w^2, with phi = w * value / sum(w^2).
    nodes control points an axis, more than the order (1 and more); every further level doubles the spans and fits what is
    left. Levels add up in one lattice, which is refined, so that the full grid is evaluated once."""
    from .stats import inside_mask

    if order < 1 or nodes <= order or levels < 1:
        raise ValueError("an order of 1 or more, more nodes than that, and a level or more")
    images = durable(headers(voxels))
    sized = voxels.join(by_image(images.select("image_id", *SIZE.values())), "image_id")
    left = durable(_bricks(inside_mask(sized, mask)))
    total, spans = None, nodes - order
    for level in range(levels):
        spans = (nodes - order) * 2**level
        lattice = durable(_lattice(left, spans, order))
        if total is not None:
            total = durable(_refined(total, images, spans // 2, order).unionByName(lattice).groupBy(*POINT).agg(F.sum("c").alias("c")))
        else:
            total = lattice
        if level + 1 < levels:
            after = durable(_fitted(left, lattice, spans, order, left=True))
            forget(left)
            left = after
    return _evaluated(sized.drop("value"), total, spans, order).withColumnRenamed("fit", "value")
