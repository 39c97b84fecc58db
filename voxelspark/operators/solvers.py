"""Variational denoising and shading removal, Poisson equations by conjugate gradients, sparse linear algebra.

Images of up to `whole` voxels are solved whole, small ones of one size together as a stack; larger ones in tiles with
halos (see tiles), which gives the same numbers.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Solver, Variation, axes_of, integrate, solve
from ..model import AXES, KEY, headers
from .durable import durable, forget
from .joins import add_background, multiply, require_same_size, subtract
from .products import product
from .stats import correlation_and_change
from .tiles import TILE, iterate_tiles, kept, tile, untile, within
from .transforms import integrate_gradients_poisson, resize, resize_like, resize_to
from .windows import div_grad, divergence

WHOLE = 1 << 21


#: Voxels of small images that a task has, by and by.
STACK = 1 << 18
#: Of these, voxels that are worked on at once, as a stack: solvers keep dozens of arrays of that many.
SLICE = 1 << 15


def stacks(rows: pd.DataFrame, columns: list[str], key: str = "image_id") -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each size among the images of rows, up to SLICE voxels (one image at least) at a time: their row numbers
    (n, z * y * x), and the columns as (n, z, y, x)."""
    order = np.lexsort([rows[c].to_numpy() for c in ("x", "y", "z", key)])
    image = rows[key].to_numpy()[order]
    first = np.flatnonzero(np.append(True, image[1:] != image[:-1]))
    last = np.append(first[1:], len(image)) - 1  # the last voxel in order is the far corner
    corners = np.stack([rows[a].to_numpy()[order][last] + 1 for a in ("z", "y", "x")], 1)
    for shape in np.unique(corners, axis=0):
        every, size = np.flatnonzero((corners == shape).all(axis=1)), int(np.prod(shape))
        for of in np.split(every, range(some := max(1, SLICE // size), len(every), some)):
            at = order[first[of][:, None] + np.arange(size)]
            yield at, [rows[c].to_numpy(float)[at].reshape(len(of), *shape) for c in columns]


def tasks_for(voxels: DataFrame, times: int = 1) -> int:
    """Tasks of about STACK voxels, each of which counts `times`, but all cores at least."""
    return max(voxels.sparkSession.sparkContext.defaultParallelism, -(-voxels.count() * times // STACK))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """rows by tasks: an image is in one task, of the column `task`."""
    return rows.withColumn("task", F.pmod(F.xxhash64("image_id"), F.lit(tasks))).repartition(tasks, "task")


def in_order(rows: DataFrame) -> DataFrame:
    """rows in as many parts as tasks_for has it, by image: images are whole, one after the other."""
    return rows.repartition(tasks_for(rows), "image_id").sortWithinPartitions("image_id")


def whole_images(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """frames of rows in the order of images, as such in which all images are whole: of SLICE rows, and what else came
    with these and with the last image. Only the rows of the image that is not at its end wait for more."""
    held, n = [], 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        n += len(frame)
        ids = frame["image_id"].to_numpy()
        if n >= SLICE and held[0]["image_id"].iat[0] != ids[-1]:
            rows = pd.concat(held, ignore_index=True)
            other = np.flatnonzero(rows["image_id"].to_numpy() != ids[-1])
            cut = int(other[-1]) + 1
            yield rows.iloc[:cut].reset_index(drop=True)
            held, n = [rows.iloc[cut:].copy()] if cut < len(rows) else [], len(rows) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def by_stacks(rows: DataFrame, columns: list[str], f: Callable[[list[np.ndarray]], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """(KEY, names) from f of the columns, stacked. A task holds no more than about a stack or an image at a time."""
    schema = ", ".join(["image_id long, x int, y int, z int", *(f"{n} double" for n in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_images(frames):
            out = {n: np.empty(len(frame)) for n in names}
            for at, fields in stacks(frame, columns):
                for n, a in f(fields).items():
                    out[n][at] = a.reshape(at.shape)
            yield frame[KEY].assign(**out)

    return in_order(rows.select(*KEY, *columns)).mapInPandas(run, schema)


def _inputs(voxels: DataFrame, problem: Variation, mask: DataFrame | None, weights: DataFrame | None) -> tuple[DataFrame, list[str]]:
    columns = ["value"]
    if problem.weights:
        voxels = voxels.join(weights.select(*KEY, F.col("value").alias("weight")), KEY)
        columns.append("weight")
    if problem.masked:
        voxels = voxels.join(mask.select(*KEY, F.col("value").alias("mask")), KEY)
        columns.append("mask")
    return voxels, columns


def _with(problem: Variation, numbers) -> Variation:
    """problem with the alphas and the weight in numbers, or as it is without any."""
    return replace(problem, alpha=tuple(numbers[:-1]), weight=numbers[-1]) if len(numbers) else problem


def _steps(problem: Variation, dims: int):
    """start and step of tiles; params: the alphas and the weight of the tile's image, or nothing."""
    start = lambda fields, params: Solver(_with(problem, params), dims).start(fields)
    return start, lambda fields, params: Solver(_with(problem, params), dims).advance(fields)


def kinds_of(images: DataFrame, size: int) -> list[tuple[bool, bool, DataFrame]]:
    """(flat, alone, images): headers by whether an image is flat, and whether it is one tile; only those there are."""
    rows = images.withColumns({"flat": F.col("depth") == 1, "alone": F.greatest("width", "height", "depth") <= size})
    found = sorted((r["flat"], r["alone"]) for r in rows.select("flat", "alone").distinct().collect())
    return [(flat, alone, rows.where((F.col("flat") == flat) & (F.col("alone") == alone))) for flat, alone in found]


def solve_images(voxels: DataFrame, problem: Variation, iterations: int, mask: DataFrame | None = None, weights: DataFrame | None = None, whole: int = WHOLE, halo: int = 8, size: int = TILE, params: DataFrame | None = None) -> DataFrame:
    """(KEY, u, vx, vy, vz) after a fixed number of iterations. params: (image_id, params), the alphas and then the weight
    of each image, where they are not those of the problem."""
    rows, columns = _inputs(voxels, problem, mask, weights)
    largest = voxels.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0

    if largest <= whole:
        rows, own = _numbered(rows, columns, problem, params)

        def run(fields: list[np.ndarray]) -> dict[str, np.ndarray]:
            fields, numbers = fields[: len(columns)], [a[:, :1, :1, :1] for a in fields[len(columns) :]]
            u, v = solve(_with(problem, numbers), fields, iterations)
            return {"u": u} | dict(zip(("vx", "vy", "vz"), [*v, *[np.zeros_like(u)] * (3 - len(v))], strict=True))

        return by_stacks(rows, columns + own, run, ["u", "vx", "vy", "vz"])

    parts = []
    for flat, alone, images in kinds_of(headers(voxels), size):
        dims = 2 if flat else 3
        start, step = _steps(problem, dims)
        tiles = tile(rows.join(images.select("image_id"), "image_id", "left_semi"), tuple(columns), size, params)
        states = iterate_tiles(tiles, start, step, iterations, halo, size, alone)
        parts.append(kept(_solution(states, problem, dims)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _solution(tiles: DataFrame, problem: Variation, dims: int) -> DataFrame:
    """(KEY, u, vx, vy, vz) from states."""
    at = Solver(problem, dims).inputs
    names = {"u": at} | ({f"v{a}": at + 2 + dims + i for i, a in enumerate(AXES[:dims])} if problem.order > 1 else {})
    return untile(tiles, names).select(*KEY, "u", *((F.col(f"v{a}") if f"v{a}" in names else F.lit(0.0)).alias(f"v{a}") for a in AXES))


def _denoised(voxels: DataFrame, problem: Variation, iterations: int, **options) -> DataFrame:
    return solve_images(voxels, problem, iterations, **options).select(*KEY, F.col("u").alias("value"))


def tv_l2(voxels: DataFrame, weight: float, alpha1: float, iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(1, (alpha1,), weight, "l2"), iterations, **options)


def tv_l1(voxels: DataFrame, weight: float, alpha1: float, iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(1, (alpha1,), weight, "l1"), iterations, **options)


def tgv2_l1(voxels: DataFrame, weight: float, alpha0: float, alpha1: float, iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(2, (alpha1, alpha0), weight, "l1"), iterations, **options)


def tgv2_l2(voxels: DataFrame, weight: float, alpha0: float, alpha1: float, iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(2, (alpha1, alpha0), weight, "l2"), iterations, **options)


def tgv2_lambda_map(voxels: DataFrame, weights: DataFrame, factor: float, offset: float, alpha0: float, alpha1: float, iterations: int, images: DataFrame | None = None, weight_images: DataFrame | None = None, **options) -> DataFrame:
    """The data term (squared) of each voxel is weighted by weights * factor + offset. Weights of another size than the
    image are an error; headers, where they are not given, are made from the voxels."""
    require_same_size(headers(voxels) if images is None else images, headers(weights) if weight_images is None else weight_images)
    scaled = weights.select(*KEY, (F.col("value") * factor + offset).alias("value"))
    return _denoised(voxels, Variation(2, (alpha1, alpha0), 0.0, "l2", weights=True), iterations, weights=scaled, **options)


def tgv3_l1(voxels: DataFrame, weight: float, alpha0: float, alpha1: float, alpha2: float, iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(3, (alpha1, alpha0, alpha2), weight, "l1", "forward"), iterations, **options)


def tgvk_l1(voxels: DataFrame, weight: float, order: int, alpha: tuple[float, ...], iterations: int, **options) -> DataFrame:
    return _denoised(voxels, Variation(order, tuple(alpha[:order]), weight, "l1"), iterations, **options)


def default_alpha(order: int) -> tuple[float, ...]:
    return tuple(1.0 + 3.0 * i for i in range(order))


def deshade(voxels: DataFrame, problem: Variation, iterations: int, mask: DataFrame | None = None, clamp: bool = False, background: bool = False, whole: int = WHOLE, div_v: bool = False, **options) -> DataFrame:
    """(KEY, denoised, shading, deshaded, and with div_v the divergence of the smooth gradient). Shading is the integral of the smooth gradient, deshaded what is left of the
    denoised image; with a mask, both only inside; clamp: no negative values; background: the denoised image outside the
    mask, not clamped."""
    found = solve_images(voxels, problem, iterations, mask=mask, whole=whole, **options)
    largest = voxels.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    found = durable(found) if largest <= whole else found  # tiles are written already
    if largest <= whole:
        shading = by_stacks(found, ["vx", "vy", "vz"], lambda v: {"value": integrate(v[: len(axes_of(v[0]))])}, ["value"])
    else:
        shading = integrate_gradients_poisson(found)
    rows = found.select(*KEY, "u").join(shading.withColumnRenamed("value", "s"), KEY)
    smooth, left = F.col("s"), F.col("u") - F.col("s")
    if mask is not None:
        rows = rows.join(mask.select(*KEY, F.col("value").alias("m")), KEY)
        smooth, left = smooth * F.col("m"), left * F.col("m")
    if clamp:
        left = F.greatest(left, F.lit(0.0))
    if mask is not None and background:
        left = left + F.col("u") * (1 - F.col("m"))
    parts = rows.select(*KEY, F.col("u").alias("denoised"), smooth.alias("shading"), left.alias("deshaded"))
    return parts.join(divergence(found).withColumnRenamed("value", "div_v"), KEY) if div_v else parts


def _clamped(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))


def _parts(denoised: DataFrame, shading: DataFrame, deshaded: DataFrame) -> DataFrame:
    named = [v.withColumnRenamed("value", n) for v, n in ((denoised, "denoised"), (shading, "shading"), (deshaded, "deshaded"))]
    return named[0].join(named[1], KEY).join(named[2], KEY)


def deshade_masked(voxels: DataFrame, mask: DataFrame, order: int, alpha: tuple[float, ...], weight: float, iterations: int, **options) -> DataFrame:
    """deshade (with its options) in which only voxels with mask >= 1 are updated; the others are read as they are."""
    return deshade(voxels, Variation(order, tuple(alpha[:order]), weight, "l1", masked=True), iterations, mask=mask, **options)


def deshade_downsampled(voxels: DataFrame, factor: float, order: int, alpha: tuple[float, ...], weight: float, iterations: int, width: int | None = None, height: int | None = None, depth: int | None = None, mask: DataFrame | None = None, clamp: bool = False, background: bool = False, masked: bool = True, params: DataFrame | None = None) -> DataFrame:
    """Solved on an image reduced by factor with cubic splines, as is the mask; shading and denoised image are enlarged
    again to the size given, or each image to its own, and the shading is taken from the input. masked: with a mask, the input and the enlarged
    shading are cut by it and only voxels inside it are updated; otherwise all of the input is, and only the reduced
    shading and the result are cut. background: the input outside the mask. clamp: after that, no negative values.

    A factor of 1 resamples nothing. Splines overshoot: a reduced mask is inside where it is 1 and more, which is tested
    to nine places, as values next to 1 are otherwise left to the order of sums."""
    problem = Variation(order, tuple(alpha[:order]), weight, "l1")
    seen = voxels if mask is None or not masked else multiply(voxels, mask)
    reduced = lambda v: v if factor == 1 else resize(v, factor, "bspline3")
    small = durable(reduced(seen))
    small_mask = None if mask is None else durable(reduced(mask).withColumn("value", F.round("value", 9)))
    if mask is not None and masked:
        solved = deshade_masked(small, small_mask, order, alpha, weight, iterations, params=params)
    else:
        solved = deshade(small, problem, iterations, small_mask, params=params)
    solved = durable(solved)
    large = {c: solved.select(*KEY, F.col(c).alias("value")) for c in ("denoised", "shading")}
    if factor != 1:
        enlarged = (lambda v: resize_like(v, headers(voxels), "bspline3")) if width is None else (lambda v: resize_to(v, width, height, depth, "bspline3"))
        large = {c: enlarged(v) for c, v in large.items()}
    shading, deshaded = large["shading"], subtract(seen, large["shading"])
    if mask is not None:
        shading, deshaded = multiply(shading, mask) if masked else shading, multiply(deshaded, mask)
        if background:
            deshaded = add_background(voxels, deshaded, mask)
    return _parts(large["denoised"], shading, _clamped(deshaded) if clamp else deshaded)


def _numbered(rows: DataFrame, columns: list[str], problem: Variation, params: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """rows with the numbers of each image's params as columns, and the names of these."""
    if params is None:
        return rows, []
    own = [f"param{i}" for i in range(problem.order + 1)]
    joined = rows.join(params, "image_id").select(*KEY, *columns, *(F.col("params")[i].alias(c) for i, c in enumerate(own)))
    return joined, own


def _history(solver: Solver, f: np.ndarray, checks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """ncc (not a number where it is null) and change of a stack, (n, checks after the first)."""
    s, done, before, flat, told = solver.start([f]), 0, None, (len(f), -1), ([], [])
    for check in checks:
        for _ in range(check - done):
            s = solver.advance(s)
        done = check
        shading = integrate(solver.split(s)[3]).reshape(flat)
        if before is not None:
            centred, centred_before = (a - a.mean(axis=1, keepdims=True) for a in (shading, before))
            sd = shading.std(axis=1, ddof=1) * before.std(axis=1, ddof=1)
            told[0].append(np.where(sd > 0, (centred * centred_before).mean(axis=1) / np.where(sd > 0, sd, 1), np.nan))
            told[1].append(np.abs(shading - before).sum(axis=1))
        before = shading
    return tuple(np.stack(x, 1) if x else np.empty((len(f), 0)) for x in told)


def histories(voxels: DataFrame, problem: Variation, checks: list[int]) -> DataFrame:
    """(image_id, iteration, ncc, change) of images that fit a task, gone through in stacks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_images(frames):
            for at, (f,) in stacks(frame, ["value"]):
                ncc, change = _history(Solver(problem, len(axes_of(f))), f, checks)
                ids = np.repeat(frame["image_id"].to_numpy()[at[:, 0]], len(checks) - 1)
                yield pd.DataFrame({"image_id": ids, "iteration": np.tile(checks[1:], len(f)), "ncc": ncc.ravel(), "change": change.ravel()})

    return in_order(voxels.select(*KEY, "value")).mapInPandas(run, "image_id long, iteration int, ncc double, change double")


def _varied(history: np.ndarray) -> np.ndarray:
    """windows.metric_total_variation of each row; what is not a number is null there."""
    steps, known = np.abs(np.diff(history, axis=1))[:, :-1], ~np.isnan(history)
    return np.where((known[:, 1:] & known[:, :-1])[:, :-1], steps, 0.0).sum(axis=1)


def variations(voxels: DataFrame, runs: DataFrame, problem: Variation, checks: list[int]) -> DataFrame:
    """runs: (image_id, run, alpha0, alpha1) -> (image_id, run, alpha0, alpha1, metric, tv): the variation of the history of
    each run, for images that fit a task. Images and runs meet in the task: what moves are the voxels of the images, once,
    and no task sorts or joins those of the runs."""
    most = runs.groupBy("image_id").count().agg(F.max("count")).first()[0] or 1
    tasks = tasks_for(voxels, most)
    kind = runs.schema["run"].dataType.simpleString()

    def run(images: pa.Table, own: pa.Table) -> pa.Table:
        frame, sets = images.select([*KEY, "value"]).to_pandas(), own.to_pandas().sort_values("image_id", kind="stable")
        out = [own.slice(0, 0).select(["image_id", "run", "alpha0", "alpha1"]).append_column("metric", pa.array([], pa.string())).append_column("tv", pa.array([], pa.float64()))]
        for at, (f,) in stacks(frame, ["value"]):
            ids = frame["image_id"].to_numpy()[at[:, 0]]  # rising, as stacks has them
            place = np.minimum(np.searchsorted(ids, sets["image_id"].to_numpy()), len(ids) - 1)
            met = np.flatnonzero(ids[place] == sets["image_id"].to_numpy())
            for some in np.split(met, range(n := max(1, SLICE // at.shape[1]), len(met), n)) if len(met) else []:
                rows = sets.iloc[some]
                alpha = tuple(rows[c].to_numpy(float)[:, None, None, None] for c in ("alpha1", "alpha0"))
                told = _history(Solver(replace(problem, alpha=alpha), len(axes_of(f))), f[place[some]], checks)
                if len(checks) > 1:
                    for metric, history in zip(("ncc", "change"), told, strict=True):
                        columns = [pa.array(rows[c].to_numpy(), out[0].schema.field(c).type) for c in ("image_id", "run", "alpha0", "alpha1")]
                        out.append(pa.table([*columns, pa.array([metric] * len(rows)), pa.array(_varied(history))], names=out[0].column_names))
        return pa.concat_tables(out)

    schema = f"image_id long, run {kind}, alpha0 double, alpha1 double, metric string, tv double"
    parts = runs.select(F.col("image_id").cast("long").alias("image_id"), "run", *(F.col(c).cast("double").alias(c) for c in ("alpha0", "alpha1")))
    return dealt(voxels.select(*KEY, "value"), tasks).groupBy("task").cogroup(dealt(parts, tasks).groupBy("task")).applyInArrow(run, schema)


#: Whether an image is done: a condition on (iteration, ncc, change) of its last check; or a function of the iteration
#: and the rows of that check, which ends all images at once.
Stop = Column | Callable[[int, DataFrame], bool]


def _shading_of(tiles: DataFrame, problem: Variation, dims: int, alone: bool) -> DataFrame:
    """(KEY, value): the shading of states, written."""
    if alone:
        at = Solver(problem, dims).inputs + 2 + dims
        return kept(untile(within(tiles, lambda fields, _: [integrate(fields[at : at + dims])]), {"value": 0}))
    found = kept(_solution(tiles, problem, dims))
    shading = durable(integrate_gradients_poisson(found))
    forget(found)
    return shading


def solve_until(voxels: DataFrame, problem: Variation, checks: list[int], stop: Stop | None, mask: DataFrame | None = None, halo: int = 8, size: int = TILE, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(KEY, u, vx, vy, vz), and the history (image_id, iteration, ncc, change), of images in tiles.

    At each check from the second on, the correlation of the shading (inside the mask, if there is one) with that of the
    check before, and the sum of their absolute differences, go to the history, and `stop` is asked. An image that is
    done takes no further step and keeps the state of that check; the others go on to the last one. ncc is null where a
    shading is constant, and a condition that is null does not stop. params: as in solve_images. Without images both
    tables are empty."""
    found, told = [], []
    for flat, alone, images in kinds_of(headers(voxels), size):
        dims, seen = 2 if flat else 3, [None]
        start, step = _steps(problem, dims)

        def at_check(iteration: int, state: DataFrame, dims: int = dims, alone: bool = alone, seen: list = seen) -> DataFrame | None:
            shading = _shading_of(state, problem, dims, alone)
            shading = shading if mask is None else durable(multiply(shading, mask))
            before, seen[0] = seen[0], shading
            if before is None:
                return None
            rows = correlation_and_change(shading, before)
            rows = durable(rows.select("image_id", F.lit(iteration).alias("iteration"), "ncc", "change"))
            forget(before)
            told.append(rows)
            if isinstance(stop, Column):
                return rows.where(stop)
            return rows if stop is not None and stop(iteration, rows) else None

        tiles = tile(voxels.join(images.select("image_id"), "image_id", "left_semi"), ("value",), size, params)
        states = iterate_tiles(tiles, start, step, max(checks), halo, size, alone, checks, at_check)
        found.append(kept(_solution(states, problem, dims)))
    spark, history = voxels.sparkSession, "image_id long, iteration int, ncc double, change double"
    out = [spark.createDataFrame([], "image_id long, x int, y int, z int, u double, vx double, vy double, vz double"), spark.createDataFrame([], history)]
    for i, parts in enumerate((found, told)):
        for part in parts:
            out[i] = out[i].unionByName(part)
    return out[0], out[1]


def convergence_history(voxels: DataFrame, problem: Variation, checks: list[int], stop: Stop | None = None, mask: DataFrame | None = None, whole: int = WHOLE, halo: int = 8, size: int = TILE) -> DataFrame:
    """(image_id, iteration, ncc, change): correlation and sum of absolute changes of the shading between checks, until
    stop. Images of up to `whole` voxels without mask and stop are gone through whole, the others as in solve_until."""
    largest = voxels.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    if stop is None and mask is None and largest <= whole:
        return histories(voxels, problem, checks)
    return solve_until(voxels, problem, checks, stop, mask, halo, size)[1]


def _minus_laplacian(f: np.ndarray) -> np.ndarray:
    """windows.div_grad of a stack of images."""
    out = np.zeros_like(f)
    for axis in range(1, f.ndim):
        d = np.diff(f, axis=axis)
        for way, ends in ((-1, (0, 1)), (1, (1, 0))):
            out += way * np.pad(d, [ends if i == axis else (0, 0) for i in range(f.ndim)])
    return out


def _conjugate(fields: list[np.ndarray], eps: float, limit: int) -> np.ndarray:
    """The steps of solve_poisson_cg for a stack, from u and the residual r."""
    u, r = (a.copy() for a in fields)
    dot = lambda a, b: (a * b).sum(axis=(1, 2, 3), keepdims=True)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    p, first = r, dot(r, r)
    rr = first
    for _ in range(limit):
        active = (first >= eps) & (rr >= eps * first) & (rr > 0)
        if not active.any():
            break
        ap = _minus_laplacian(p)
        a = np.where(active, over(rr, dot(p, ap)), 0.0)
        u, r = u + a * p, r - a * ap
        new = dot(r, r)
        p, rr = r + over(new, rr) * p, new
    return u


def solve_poisson_cg(f: DataFrame, eps: float = 1e-6, steps: int | None = None, start: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """div_grad(u) = f by conjugate gradients from start or 0, all images at once.

    An image whose squared residual is below eps at first, or falls below eps times its first one, stays as it is; at
    most `steps` or voxels - 2 steps, of the largest image. Images of up to `whole` voxels, dense and finite, are gone
    through in stacks; the others in tables, where a step is one shuffle and two sums."""
    state = f.select(*KEY, F.lit(0.0).alias("u"), F.col("value").alias("r"))
    if start is not None:
        seen = div_grad(start).withColumnRenamed("value", "seen").join(start.withColumnRenamed("value", "u0"), KEY)
        state = f.join(seen, KEY).select(*KEY, F.col("u0").alias("u"), (F.col("value") - F.col("seen")).alias("r"))
    state = durable(state)
    usual = (F.abs("u") < float("inf")) & (F.abs("r") < float("inf")) & (F.least(*AXES) >= 0)
    corner = F.lit(1)
    for a in AXES:
        corner = corner * (F.max(a) + F.lit(1).cast("long"))
    images = state.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(usual) == corner).alias("dense"))
    images = durable(images.withColumn("fits", (F.col("n") <= whole) & F.col("dense") & F.col("image_id").isNotNull()))
    most = images.agg(F.max("n"), F.bool_and("fits"), F.bool_or("fits")).first()
    limit = steps if steps is not None else max(0, (most[0] or 0) - 2)
    stacked = lambda rows: by_stacks(rows, ["u", "r"], lambda fields: {"value": _conjugate(fields, eps, limit)}, ["value"])
    if most[1]:
        return stacked(state)
    if not most[2]:
        return _poisson_tables(state, eps, limit)
    fits = images.where("fits").select("image_id")
    return stacked(state.join(fits, "image_id", "left_semi")).unionByName(_poisson_tables(state.join(fits, "image_id", "left_anti"), eps, limit))


def _poisson_tables(state: DataFrame, eps: float, limit: int) -> DataFrame:
    state = durable(state.withColumn("p", F.col("r")))
    sizes = state.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr0"))
    rows = durable(sizes.withColumn("rr", F.col("rr0")))
    for _ in range(limit):
        active = rows.where((F.col("rr0") >= eps) & (F.col("rr") >= eps * F.col("rr0")) & (F.col("rr") > 0))
        if active.isEmpty():
            break
        ap = div_grad(state.select(*KEY, F.col("p").alias("value"))).withColumnRenamed("value", "ap")
        both = durable(state.join(ap, KEY))
        step = both.groupBy("image_id").agg(F.sum(F.col("p") * F.col("ap")).alias("pap"))
        known = active.select("image_id", "rr").join(step, "image_id").select("image_id", F.coalesce(F.try_divide("rr", "pap"), F.lit(0.0)).alias("a"))
        a = F.coalesce("a", F.lit(0.0))
        moved = durable(both.join(known, "image_id", "left").select(*KEY, (F.col("u") + a * F.col("p")).alias("u"), (F.col("r") - a * F.col("ap")).alias("r"), "p"))
        new = moved.groupBy("image_id").agg(F.sum(F.col("r") * F.col("r")).alias("new"))
        next_rows = durable(rows.join(new, "image_id").select("image_id", "n", "rr0", "rr", "new"))
        beta = next_rows.select("image_id", F.when(F.col("rr") > 0, F.col("new") / F.col("rr")).otherwise(0.0).alias("b"))
        next_state = durable(moved.join(beta, "image_id").select(*KEY, "u", "r", (F.col("r") + F.col("b") * F.col("p")).alias("p")))
        forget(state, both, moved)
        state, rows = next_state, next_rows.select("image_id", "n", "rr0", F.col("new").alias("rr"))
    return state.select(*KEY, F.col("u").alias("value"))


# --- sparse matrices (row, col, val) and vectors (i, val)


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    met = matrix.join(vector.select(F.col("i").alias("col"), F.col("val").alias("x")), "col")
    return met.groupBy(F.col("row").alias("i")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("val").alias("val"))


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b, in tiles: see products."""
    return product(a, b)


#: Entries of a block of columns, which one task multiplies at once.
ENTRIES = 1 << 20


def _times(block: pa.Table, x: pa.Table) -> pa.Table:
    """(i, ap): the sums of a block's rows over its columns; nulls add nothing."""
    at = pc.index_in(block["col"].combine_chunks(), value_set=x["i"].combine_chunks())
    terms = block.select(["row"]).append_column("ap", pc.multiply(block["val"], pc.take(x["p"].combine_chunks(), at)))
    sums = pc.drop_null(terms).group_by("row").aggregate([("ap", "sum")])
    return pa.table({"i": sums["row"], "ap": sums["ap_sum"]})


def _in_blocks(matrix: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The matrix in blocks of neighbouring columns, kept where it is by block, and the block of a column's number."""
    n = max(1, -(-matrix.count() // ENTRIES))
    ends = np.array(matrix.approxQuantile("col", [i / n for i in range(1, n)], 0.1 / n)) if n > 1 else np.empty(0)

    @F.pandas_udf("int")
    def block(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, i.to_numpy(), "right"))

    tasks = max(n, int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = matrix.where("col is not null").select("row", "col", F.col("val").cast("double").alias("val"), block("col").alias("block"))
    return entries.repartition(tasks, "block").persist(StorageLevel.DISK_ONLY), block


def cg_solve(matrix: DataFrame, f: DataFrame, eps: float = 1e-8, steps: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """matrix x = f for a symmetric positive definite matrix, from start (i, val) or 0. Stops when r.r is below eps at
    first, or below eps times the first, or after `steps`, by default unknowns - 2; warns if that was too early.

    The matrix moves once, to tasks by blocks of columns; a step moves the vectors, and one sum for each row of a block.
    The entries of one column fit a task."""
    x = f.select("i", F.lit(0.0).alias("x"), F.col("val").alias("r"))
    if start is not None:
        x = x.join(start.select("i", F.col("val").alias("x0")), "i", "left").join(spmv(matrix, start).withColumnRenamed("val", "seen"), "i", "left")
        x = x.select("i", F.coalesce("x0", F.lit(0.0)).alias("x"), (F.col("r") - F.coalesce("seen", F.lit(0.0))).alias("r"))
    kept, block = _in_blocks(matrix)
    x = durable(x.withColumn("p", F.col("r")).withColumn("block", F.when(F.col("i").isNotNull(), block(F.coalesce("i", F.lit(0))))))
    schema = f"i {matrix.schema['row'].dataType.simpleString()}, ap double"
    rr = first = x.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(0 if first < eps else max(0, x.count() - 2) if steps is None else steps):
        if rr < eps * first or not rr:
            break
        met = x.where("block is not null").select("block", "i", F.col("p").cast("double").alias("p"))
        ap = kept.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_times, schema).groupBy("i").agg(F.sum("ap").alias("ap"))
        both = x.join(ap, "i", "left").fillna(0.0, ["ap"]).persist(StorageLevel.DISK_ONLY)
        pap = both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        a = rr / pap
        new = both.select("i", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("ap")).alias("r"), "p", "block")
        rr_new = new.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        after = durable(new.select("i", "x", "r", (F.col("r") + rr_new / rr * F.col("p")).alias("p"), "block"))
        both.unpersist()
        forget(x)
        x, rr = after, rr_new
    kept.unpersist()
    if first >= eps and rr >= eps * first:
        warnings.warn(f"conjugate gradients: r.r is {rr:.3g}, {rr / first:.3g} of the first", stacklevel=2)
    return x.select("i", F.col("x").alias("val"))
