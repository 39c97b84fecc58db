"""Task lists: every task names an image, a mask, a way of removing the shading and a line; all are run and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Variation
from ..model import KEY
from ..sources.files import with_value_channel
from .durable import durable
from .solvers import deshade, deshade_downsampled, deshade_masked
from .stats import compare_metrics, histogram, image_metrics
from .windows import line_profile

#: What tasks that are solved together have in common; alphas and weights are numbers of each task.
SETTINGS = ["from_input", "not_masked", "has_mask", "f_downsampling", "iteration_count", "order"]
AXES = ("x", "y", "z")


def bind_tasks(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """tasks as read_tasks gives them, with task_id; names: (name, image_id). Adds image_id by the input's name and mask_id
    by the mask's; a mask without a name there is null, as a mask that cannot be loaded; an unknown input is an error."""
    inputs = names.select(F.col("name").alias("input"), "image_id")
    masks = names.select(F.col("name").alias("mask"), F.col("image_id").alias("mask_id"))
    missing = F.raise_error(F.concat(F.lit("no image of this name: "), F.col("input"))).cast("long")
    bound = tasks.join(inputs, "input", "left").join(masks, "mask", "left")
    return bound.withColumn("image_id", F.coalesce("image_id", missing))


def _flags(tasks: DataFrame) -> DataFrame:
    """tasks that do something, with what their modes say."""
    has = lambda word: F.col("mode").contains(word)
    some = tasks.where(has("SubtractFromInput") | has("SubtractFromDenoised"))
    factor = F.when(has("SubtractFromInput"), F.col("f_downsampling")).otherwise(1.0)  # others are not reduced
    return some.withColumns({"from_input": has("SubtractFromInput"), "not_masked": has("NotMasked"), "has_mask": F.col("mask_id").isNotNull(), "f_downsampling": factor, "order": F.size("alpha")})


def _of_tasks(voxels: DataFrame, tasks: DataFrame, column: str = "image_id") -> DataFrame:
    """The voxels of each task, with the task as image_id."""
    return voxels.join(tasks.select(F.col(column).alias("image_id"), "task_id"), "image_id").select(F.col("task_id").alias("image_id"), "x", "y", "z", "value")


def _run(setting, seen: DataFrame, mask: DataFrame | None, params: DataFrame) -> DataFrame:
    alpha, after = (1.0,) * setting.order, {"clamp": True, "background": True, "params": params}
    if setting.from_input:
        return deshade_downsampled(seen, setting.f_downsampling, setting.order, alpha, 1.0, setting.iteration_count, mask=mask, **after, masked=not setting.not_masked)
    if mask is None or setting.not_masked:
        return deshade(seen, Variation(setting.order, alpha, 1.0, "l1"), setting.iteration_count, mask, **after)
    return deshade_masked(seen, mask, setting.order, alpha, 1.0, setting.iteration_count, **after)


def run_tasks(tasks: DataFrame, voxels: DataFrame) -> DataFrame:
    """tasks: (task_id, image_id, mask_id, mode, f_downsampling, lambda, iteration_count, alpha) over images and masks in
    voxels -> (KEY, denoised, shading, deshaded) with the task as image_id.

    mode has SubtractFromInput, or else SubtractFromDenoised; a task with neither does nothing and has no rows. With
    NotMasked all voxels are updated and the mask only cuts the result. Negative values become 0 and the background is put
    back. Tasks of one way, order, factor and number of iterations are solved together, whatever their alphas, weights and
    sizes, so there is one pass for each combination of these in the list. No tasks: no rows.
    """
    tasks = durable(_flags(tasks))
    out = None
    for setting in tasks.select(*SETTINGS).distinct().orderBy(*SETTINGS).collect():
        own = tasks.where(_all([F.col(c).eqNullSafe(F.lit(setting[c])) for c in SETTINGS]))
        params = own.select(F.col("task_id").alias("image_id"), F.concat(F.col("alpha").cast("array<double>"), F.array(F.col("lambda").cast("double"))).alias("params"))
        found = _run(setting, _of_tasks(voxels, own), _of_tasks(voxels, own, "mask_id") if setting.has_mask else None, params)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return tasks.sparkSession.createDataFrame([], "image_id long, x int, y int, z int, denoised double, shading double, deshaded double")
    return out


def color_results(tasks: DataFrame, results: DataFrame, pixels: DataFrame) -> DataFrame:
    """(task_id, image, x, y, z, b, g, r) of the tasks whose mode has Color: input, denoised and deshaded image as colour
    images. pixels: (KEY, b, g, r, value) as read_color_images gives them; the hue and saturation of the task's image stay,
    and results of run_tasks become its value channel. Sizes that differ are an error."""
    own = tasks.where(F.col("mode").contains("Color"))
    template = pixels.join(own.select("image_id", "task_id"), "image_id").select(F.col("task_id").alias("image_id"), "x", "y", "z", "b", "g", "r", "value")
    kept = results.join(own.select(F.col("task_id").alias("image_id")), "image_id", "left_semi")
    images = {"input": template.select(*KEY, "value")} | {c: kept.select(*KEY, F.col(c).alias("value")) for c in ("denoised", "deshaded")}
    out = None
    for name, voxels in images.items():
        part = with_value_channel(voxels, template.drop("value")).withColumn("image", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("image_id").alias("task_id"), "image", "x", "y", "z", "b", "g", "r")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def task_masks(tasks: DataFrame, voxels: DataFrame) -> DataFrame:
    """The mask of each task; 1 everywhere for one without."""
    bare = _of_tasks(voxels, tasks.where("mask_id is null"))
    return _of_tasks(voxels, tasks.where("mask_id is not null"), "mask_id").unionByName(bare.withColumn("value", F.lit(1.0)))


def evaluate_tasks(tasks: DataFrame, voxels: DataFrame, results: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(task_id, kind, image, item, at, value) of tasks with line_start and line_end, and the results of run_tasks.

    kind 'change': entropy, cv and mean_tv of the deshaded image against the input, in per cent; image is 'deshaded'.
    kind 'histogram': share of the mask's voxels in bin `item`, from intensity `at`, of both images.
    kind 'profile': the value at place `item` of the line, at distance `at` from its start, of both images; a line with an
    end outside the image has no rows.
    """
    masks = durable(task_masks(tasks, voxels))
    images = {"input": _of_tasks(voxels, tasks), "deshaded": results.select(*KEY, F.col("deshaded").alias("value"))}
    ends = [F.col(c)[i].cast("int").alias(f"{a}{n}") for n, c in ((1, "line_start"), (2, "line_end")) for i, a in enumerate(AXES)]
    lines = tasks.select(F.col("task_id").alias("image_id"), F.col("task_id").alias("line_id"), *ends)
    row = lambda kind, image, item, at, value: [F.col("image_id").alias("task_id"), F.lit(kind).alias("kind"), F.lit(image).alias("image"), item.cast("string").alias("item"), at.cast("double").alias("at"), value.alias("value")]

    change = compare_metrics(*(image_metrics(v, masks) for v in images.values()))
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("entropy", "cv", "mean_tv")))).alias("m")
    out = change.select("image_id", names).select(*row("change", "deshaded", F.col("m.name"), F.lit(None), F.col("m.value")))
    for image, v in images.items():
        counted = histogram(v, bins, low, high, masks)
        out = out.unionByName(counted.select(*row("histogram", image, F.col("bin"), F.col("intensity"), F.col("probability"))))
        out = out.unionByName(line_profile(v, lines).select(*row("profile", image, F.col("pos"), F.col("distance"), F.col("value"))))
    return out
