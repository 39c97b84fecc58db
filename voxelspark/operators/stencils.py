"""Neighbourhood operators. Taps outside the image are skipped.

Small kernels: every voxel is sent to the positions that read it and summed there (shift and aggregate), with partial
sums before the shuffle. Wide kernels: see tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..model import KEY, SIZE, by_image, headers
from .durable import durable
from .lines import along
from .solvers import WHOLE, by_stacks
from .tiles import by_blocks

Taps = list[tuple[int, int, int, float]]


def taps3x3(k: list[float]) -> Taps:
    return [(dx, dy, 0, k[3 * (dy + 1) + dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def taps3x3x3(k: list[float]) -> Taps:
    return [(dx, dy, dz, k[9 * (dz + 1) + 3 * (dy + 1) + dx + 1]) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def preset(name: str, three_d: bool = False) -> Taps:
    """laplace: centre 6, faces -1, the rest 0; mean: ones, not normalised. In 3-D the outer layers have the corner
    weight except for their centre, which is a face."""
    corner, face, centre = {"laplace": (0.0, -1.0, 6.0), "mean": (1.0, 1.0, 1.0)}[name]
    flat = [corner, face, corner, face, centre, face, corner, face, corner]
    if not three_d:
        return taps3x3(flat)
    layer = [corner] * 4 + [face] + [corner] * 4
    return taps3x3x3(layer + flat + layer)


def shifted(voxels: DataFrame, taps: Taps, images: DataFrame) -> DataFrame:
    """(KEY of the reading voxel, value of the tap, k, dx, dy, dz) of the readers inside the image. Sizes are joined before
    voxels are multiplied, so a join that has to shuffle moves each of them once."""
    each = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(float(k)).alias("k")) for dx, dy, dz, k in taps)))
    sized = voxels.select(*KEY, "value").join(by_image(images.select("image_id", *SIZE.values())), "image_id")
    sent = sized.select(*KEY, "value", *SIZE.values(), each.alias("t"))
    sent = sent.select("image_id", *((F.col(a) - F.col(f"t.d{a}")).alias(a) for a in "xyz"), "value", "t.k", "t.dx", "t.dy", "t.dz", *SIZE.values())
    return sent.where("x >= 0 and y >= 0 and z >= 0 and x < width and y < height and z < depth").drop(*SIZE.values())


def convolve(voxels: DataFrame, taps: Taps, dynamic_centre: bool = False, images: DataFrame | None = None) -> DataFrame:
    """Correlation (the kernel is not flipped). With dynamic_centre the own value times the sum of the present other
    weights is subtracted instead of the centre's tap."""
    images = headers(voxels) if images is None else images
    centre = (F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0)
    rows = shifted(voxels, taps, images)
    if not dynamic_centre:
        return rows.groupBy(*KEY).agg(F.sum(F.col("value") * F.col("k")).alias("value"))
    sums = rows.groupBy(*KEY).agg(
        F.sum(F.when(~centre, F.col("value") * F.col("k")).otherwise(0.0)).alias("sum"),
        F.sum(F.when(~centre, F.col("k")).otherwise(0.0)).alias("k"),
        F.max(F.when(centre, F.col("value"))).alias("own"),
    )
    return sums.select(*KEY, (F.col("sum") - F.col("own") * F.col("k")).alias("value"))


def binary_dilate(voxels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """1 where the voxel or one of its four neighbours in the plane is above 0.5, else 0."""
    images = headers(voxels) if images is None else images
    cross = [(0, 0, 0, 1.0), (-1, 0, 0, 1.0), (1, 0, 0, 1.0), (0, -1, 0, 1.0), (0, 1, 0, 1.0)]
    return shifted(voxels, cross, images).groupBy(*KEY).agg(F.max(F.when(F.col("value") > 0.5, 1.0).otherwise(0.0)).alias("value"))


def neighbours(positions: DataFrame, images: DataFrame, in_slice: bool = True) -> DataFrame:
    """(image_id, x, y, z, nx, ny, nz): the 8 (or 26) neighbours and the centre of each position, clipped."""
    taps = [(dx, dy, dz, 1.0) for dz in ((0,) if in_slice else (-1, 0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    near = shifted(positions.select(*KEY, F.lit(0.0).alias("value")), taps, images)
    return near.select("image_id", *((F.col(a) + F.col(f"d{a}")).alias(a) for a in "xyz"), *(F.col(a).alias(f"n{a}") for a in "xyz"))


def gaussian_kernel(size: int, sigma: float) -> Taps:
    """size^3 taps exp(-r^2 / sigma), normalised, around size // 2."""
    at = [i - size // 2 for i in range(size)]
    raw = [(dx, dy, dz, math.exp(-(dx * dx + dy * dy + dz * dz) / sigma)) for dz in at for dy in at for dx in at]
    total = sum(k for *_, k in raw)
    return [(dx, dy, dz, k / total) for dx, dy, dz, k in raw]


def pairwise(voxels: DataFrame, taps: Taps, term: Column) -> DataFrame:
    """(KEY, own, value, k, ...) joined back to each reading voxel's own value, with term as `term`."""
    own = voxels.select(*KEY, F.col("value").alias("own")).hint("merge")
    return shifted(voxels, taps, headers(voxels)).join(own, KEY).withColumn("term", term)


def _by_neighbourhood(voxels: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int, wide: bool | None, pairs: Callable[[], DataFrame]) -> DataFrame:
    """f, of radius size // 2, over voxels that move once: images of up to WHOLE voxels whole, small ones of one size as a
    stack; by blocks with wide, for larger images, and by default for kernels over 125 taps. pairs: the same for images
    with holes, by a row a tap."""
    if wide is None:
        wide = size**3 > 125
    if not wide:
        counts = voxels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *((F.max(a) + 1).alias(n) for a, n in SIZE.items()))
        most, holes = counts.agg(F.max("n"), F.max(F.col("n") != F.col("width").cast("long") * F.col("height") * F.col("depth"))).first()
        if holes:
            return pairs()
        wide = (most or 0) > WHOLE
    if wide:
        return by_blocks(voxels, f, halo=size // 2 + 1)
    return by_stacks(voxels, ["value"], lambda fields: {"value": f(fields[0])}, ["value"])


def non_local_gradient(voxels: DataFrame, size: int, sigma: float, wide: bool | None = None) -> DataFrame:
    """Sum of |own - tap| * weight; the centre adds nothing. wide: by blocks."""

    def pairs() -> DataFrame:
        terms = pairwise(voxels, gaussian_kernel(size, sigma), F.abs(F.col("own") - F.col("value")) * F.col("k"))
        return terms.groupBy(*KEY).agg(F.sum("term").alias("value"))

    return _by_neighbourhood(voxels, lambda a: kernels.non_local_gradient(a, size, sigma), size, wide, pairs)


def bilateral(voxels: DataFrame, size: int = 16, sigma_space: float = 100.0, sigma_value: float = 0.05, wide: bool | None = None) -> DataFrame:
    """Mean of the box weighted by exp(-r^2 / sigma_space) * exp(-d^2 / sigma_value). wide: by blocks."""

    def pairs() -> DataFrame:
        at = [i - size // 2 for i in range(size)]
        taps = [(dx, dy, dz, math.exp(-(dx * dx + dy * dy + dz * dz) / sigma_space)) for dz in at for dy in at for dx in at]
        d = F.col("own") - F.col("value")
        terms = pairwise(voxels, taps, F.col("k") * F.exp(-d * d / sigma_value))
        return terms.groupBy(*KEY).agg((F.sum(F.col("term") * F.col("value")) / F.sum("term")).alias("value"))

    return _by_neighbourhood(voxels, lambda a: kernels.bilateral(a, size, sigma_space, sigma_value), size, wide, pairs)


def gaussian_weights(variance: float, max_width: int) -> list[float]:
    """The sampled discrete Gaussian exp(-t) I_n(t) for n = -r..r, renormalised; r is the first at which the weights hold
    0.99 of the whole, or what max_width allows."""
    t, limit = variance, (max_width - 1) // 2

    def bessel(n: int) -> float:
        # e^-t I_n(t) by its integral over half a turn
        a = np.linspace(0, np.pi, 2001)
        return float(np.trapezoid(np.exp(t * (np.cos(a) - 1)) * np.cos(n * a), a) / np.pi)

    half = [bessel(0)]
    while len(half) <= limit and half[0] + 2 * sum(half[1:]) < 0.99:
        half.append(bessel(len(half)))
    full = half[:0:-1] + half
    return [w / sum(full) for w in full]


@lru_cache(maxsize=1 << 12)
def _weights(variance: float, max_width: int) -> np.ndarray:
    return np.array(gaussian_weights(variance, max_width))


def gaussian_blur(voxels: DataFrame, variance: float, max_width: int = 32, images: DataFrame | None = None) -> DataFrame:
    """Separable discrete Gaussian, with the border voxels repeated outside: one shuffle an axis. The variance is in
    physical units: along an axis it is variance / spacing^2 voxels, so each image has its own weights for each axis.
    Without headers all spacings are 1."""
    images = durable(headers(voxels) if images is None else images)

    def taps(n: int, m: int, own: tuple[float, ...], to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = _weights(variance / own[0] ** 2, max_width)
        at = to[:, None] + np.arange(len(k)) - len(k) // 2
        return np.clip(at, 0, n - 1), np.broadcast_to(k, at.shape)

    out = voxels
    for a, n in SIZE.items():
        sizes = images.select("image_id", F.col(n).alias("n"), F.col(n).alias("m"), F.col(f"s{a}").cast("double").alias("spacing"))
        out = along(out, sizes, a, taps, (max_width - 1) // 2, ("spacing",))
    return out


def unsharp_mask(voxels: DataFrame, size: int, sigma: float, factor: float) -> DataFrame:
    blurred = gaussian_blur(voxels, sigma, size).withColumnRenamed("value", "soft")
    return voxels.join(blurred.hint("merge"), KEY).select(*KEY, (F.col("value") + factor * (F.col("value") - F.col("soft"))).alias("value"))


def multiscale_retinex(voxels: DataFrame, scales: list[tuple[float, float]]) -> DataFrame:
    """scales: (sigma, weight). Weighted mean over the scales of ln(v + 1) - ln(blurred + 1)."""
    total = sum(w for _, w in scales)
    parts = None
    for sigma, weight in scales:
        soft = gaussian_blur(voxels, sigma, 32).select(*KEY, (F.log(F.col("value") + 1) * (weight / total)).alias("part"))
        parts = soft if parts is None else parts.unionByName(soft)
    sums = parts.groupBy(*KEY).agg(F.sum("part").alias("soft"))
    return voxels.join(sums.hint("merge"), KEY).select(*KEY, (F.log(F.col("value") + 1) - F.col("soft")).alias("value"))
