"""Batches: parameter sweeps, searches of step sizes, downsampling studies and scans of alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import Variation
from ..model import KEY
from .durable import durable
from .joins import grid_sweep
from .solvers import WHOLE, deshade, solve_until, variations
from .stats import RATIOS, SCAN_RATIOS, best_ratio, image_metrics, select_step_sizes
from .tiles import TILE
from .windows import metric_total_variation


def linear_range(low: float, high: float, count: int) -> list[float]:
    return [low + (high - low) * i / max(1, count - 1) for i in range(count)]


def geometric_range(low: float, high: float, factor: float) -> list[float]:
    out = [low]
    while out[-1] * factor <= high * (1 + 1e-12):
        out.append(out[-1] * factor)
    return out


def parameter_grid(spark: SparkSession, alpha0: list[float], alpha1: list[float] | None, weight: float = 1.0) -> DataFrame:
    """(alpha0, alpha1, weight): all pairs, or alpha1 = alpha0 where alpha1 is None."""
    pairs = [(a, a) for a in alpha0] if alpha1 is None else [(a, b) for b in alpha1 for a in alpha0]
    return spark.createDataFrame([(float(a), float(b), float(weight)) for a, b in pairs], "alpha0 double, alpha1 double, weight double")


def run_table(voxels: DataFrame, params: DataFrame) -> DataFrame:
    """(run, run_id, image_id, set_no, the parameters, ready): a row for every image and parameter set, written once. run
    is a number that no other row has. Not ready: a parameter is null, not finite, or not above 0, or the image lacks
    voxels or has one that is null or not finite."""
    names = params.columns
    sound = F.lit(True)
    for c in names:
        sound = sound & F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    usual = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    whole = F.count_if(usual) == (F.max("x") + 1) * (F.max("y") + 1) * (F.max("z") + 1)
    images = voxels.groupBy("image_id").agg((whole & (F.count(F.lit(1)) == F.count_if(usual))).alias("dense"))
    runs = grid_sweep(images.select("image_id"), params).join(images, "image_id")
    return durable(runs.select(F.monotonically_increasing_id().alias("run"), "run_id", "image_id", "set_no", *names, (sound & F.col("dense")).alias("ready")))


def _of_runs(voxels: DataFrame, runs: DataFrame) -> DataFrame:
    """The voxels of each run's image, with the run as image_id."""
    return voxels.join(runs.select("image_id", "run"), "image_id").select(F.col("run").alias("image_id"), "x", "y", "z", "value")


def sweep(voxels: DataFrame, runs: DataFrame, alphas: list[str], iterations: int, mask: DataFrame | None = None, clamp: bool = False, background: bool = False, masked: bool = False, **options) -> DataFrame:
    """Shading removal of the images of the runs of run_table that are ready: (KEY, denoised, shading, deshaded) with the
    run as image_id. alphas: the columns of alpha, by level. masked: only voxels inside the mask are updated. All runs are
    one job chain: images that fit a task in stacks, others in tiles, as solve_images has it."""
    ready = runs.where("ready")
    numbers = ready.select(F.col("run").alias("image_id"), F.array(*(F.col(c).cast("double") for c in [*alphas, "weight"])).alias("params"))
    problem = Variation(len(alphas), (1.0,) * len(alphas), 1.0, "l1", masked=masked)
    masks = None if mask is None else _of_runs(mask, ready)
    return deshade(_of_runs(voxels, ready), problem, iterations, masks, clamp, background, params=numbers, **options)


def run_sweep(voxels: DataFrame, params: DataFrame, iterations: int, mask: DataFrame | None = None, clamp: bool = False, background: bool = False, masked: bool = False, **options) -> DataFrame:
    """Shading removal of every image with every parameter set: (run_id, KEY, denoised, shading, deshaded, passed).

    params: (alpha0, alpha1, weight) as parameter_grid gives them, and alpha2, ... for higher orders. A run that is not
    ready, or whose result is not finite, has one row without values and passed = false; it touches no other run."""
    runs = run_table(voxels, params)
    found = durable(sweep(voxels, runs, alpha_columns(params), iterations, mask, clamp, background, masked, **options))
    parts = ("denoised", "shading", "deshaded")
    usual = F.lit(True)
    for c in parts:
        usual = usual & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    passed = durable(found.groupBy(F.col("image_id").alias("run")).agg(F.bool_and(usual).alias("passed")))
    judged = runs.select("run", "run_id", "image_id").join(passed, "run", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    good = found.withColumnRenamed("image_id", "run").join(judged.where("passed"), "run")
    bad = judged.where("not passed").select("image_id", "run_id", *(F.lit(0).alias(a) for a in "xyz"), *(F.lit(None).cast("double").alias(c) for c in parts), "passed")
    return good.select("image_id", "run_id", "x", "y", "z", *parts, "passed").unionByName(bad)


def alpha_columns(params: DataFrame) -> list[str]:
    """The columns of alpha by level: alpha1 bounds the gradient, alpha0 its derivative, then come alpha2 and above."""
    return ["alpha1", "alpha0", *sorted((c for c in params.columns if c.startswith("alpha") and c not in ("alpha0", "alpha1")), key=lambda c: int(c[5:]))]


def run_rows(runs: DataFrame, params: DataFrame, iterations: int, kind: str = "mha") -> DataFrame:
    """runs as run_sweep gives them -> a row for each run, as insert_runs takes them: image_id, id (from 1, by alpha1 and
    then alpha0), the parameters, iteration_count, passed and the names of the three output files of this kind."""
    flags = runs.groupBy("image_id", "run_id").agg(F.bool_and("passed").alias("passed"))
    rows = grid_sweep(flags.select("image_id").distinct(), params).join(flags, ["image_id", "run_id"])
    order = Window.partitionBy("image_id").orderBy("alpha1", "alpha0", *(c for c in params.columns if c not in ("alpha0", "alpha1")))
    rows = rows.withColumn("id", F.row_number().over(order))
    files = [F.format_string(f"{name}_%04d.{kind}", "id").alias(f"output_{name}_file") for name in ("denoised", "shading", "deshaded")]
    return rows.select("image_id", "id", "run_id", *params.columns, F.lit(iterations).alias("iteration_count"), "passed", *files)


def evaluate_runs(source: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, entropy, cv, mean_tv): changes in per cent of the source's metrics by the deshaded image."""
    keys = runs.where("passed").select("run_id", "image_id").distinct()
    numbered = durable(keys.select("run_id", F.col("image_id").alias("source_id"), F.monotonically_increasing_id().alias("n")))
    deshaded = runs.where("passed").join(numbered.select("run_id", "n"), "run_id").select(F.col("n").alias("image_id"), "x", "y", "z", F.col("deshaded").alias("value"))
    names = ("entropy", "cv", "mean_tv")
    before = image_metrics(source).select(F.col("image_id").alias("source_id"), *(F.col(c).alias(f"{c}_1") for c in names))
    after = image_metrics(deshaded).select(F.col("image_id").alias("n"), *names)
    both = numbered.join(before, "source_id").join(after, "n")
    return both.select("run_id", *((F.try_divide(F.col(f"{c}_1") - F.col(c), F.col(f"{c}_1")) * 100).alias(c) for c in names))


def best_runs(evaluated: DataFrame, metric: str = "entropy") -> DataFrame:
    """The run of each image with the largest fall of the metric."""
    image = F.split("run_id", "-")[0].cast("long").alias("image_id")
    return evaluated.groupBy(image).agg(F.max_by("run_id", F.struct(F.col(metric), F.col("run_id"))).alias("run_id"), F.max(metric).alias(metric))


def alpha_scan(voxels: DataFrame, alphas: list[float], ratio: float, weight: float, iterations: int) -> DataFrame:
    """Sweep over alpha with alpha1 = alpha * ratio, as evaluated runs."""
    spark = voxels.sparkSession
    params = spark.createDataFrame([(float(a), float(a * ratio), float(weight)) for a in alphas], "alpha0 double, alpha1 double, weight double")
    return evaluate_runs(voxels, run_sweep(voxels, params, iterations))


def scored_histories(voxels: DataFrame, runs: DataFrame, weight: float, checks: list[int], whole: int = WHOLE, size: int = TILE) -> DataFrame:
    """runs: (image_id, run, alpha0, alpha1) -> (image_id, run, alpha0, alpha1, metric, tv): the variation of a run's
    convergence history.

    Images of up to `whole` voxels are gone through in stacks, larger ones in tiles, all runs together."""
    largest = voxels.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    problem = Variation(2, (1.0, 1.0), weight)
    if largest <= whole:
        return variations(voxels, runs, problem, checks)
    numbered = durable(runs.withColumn("n", F.monotonically_increasing_id()))
    params = numbered.select(F.col("n").alias("image_id"), F.array(F.col("alpha1"), F.col("alpha0"), F.lit(float(weight))).alias("params"))
    each = voxels.join(numbered.select("image_id", "n"), "image_id").select(F.col("n").alias("image_id"), "x", "y", "z", "value")
    told = solve_until(each, problem, checks, None, size=size, params=params)[1]
    history = told.withColumnRenamed("image_id", "n").join(numbered, "n")
    each = F.explode(F.create_map(F.lit("ncc"), F.col("ncc"), F.lit("change"), F.col("change"))).alias("metric", "value")
    tv = metric_total_variation(history.select(F.struct("image_id", "run", "alpha0", "alpha1").alias("run"), F.col("iteration").alias("t"), each))
    return tv.select("run.image_id", "run.run", "run.alpha0", "run.alpha1", "metric", "tv")


def equal_alpha_scan(voxels: DataFrame, alphas: list[float], weight: float = 1.0, count: int = 10) -> DataFrame:
    """(image_id, run, alpha0, alpha1, metric, tv): the variation of the convergence history over `count` iterations, a
    check each, with alpha0 = alpha1 = each of alphas; run is its place, from 0."""
    tried = F.posexplode(F.array(*(F.lit(float(a)) for a in alphas))).alias("run", "alpha0")
    runs = voxels.select("image_id").distinct().select("image_id", tried).withColumn("alpha1", F.col("alpha0"))
    return scored_histories(voxels, runs, weight, list(range(1, count + 1)))


def decades(scan: DataFrame) -> DataFrame:
    """(image_id, alpha1) from an equal_alpha_scan over 1, 0.1, 0.01, ...: two decades above the first alpha for which a
    metric has no variation (null or not a number); images without such an alpha are left out."""
    none = scan.where(F.col("tv").isNull() | F.isnan("tv")).groupBy("image_id").agg(F.min("run").alias("run"))
    return none.select("image_id", F.pow(F.lit(10.0), -(F.col("run") - 1)).alias("alpha1"))


def ratio_scan(voxels: DataFrame, chosen: DataFrame, ratios: tuple[float, ...] = SCAN_RATIOS, weight: float = 1.0, count: int = 10) -> DataFrame:
    """As equal_alpha_scan, for alpha0 = ratio * alpha1 with each ratio. chosen: (image_id, alpha1)."""
    tried = F.posexplode(F.array(*(F.lit(float(r)) for r in ratios))).alias("run", "ratio")
    runs = chosen.select("image_id", "alpha1", tried).withColumn("alpha0", F.col("alpha1") * F.col("ratio")).drop("ratio")
    return scored_histories(voxels, runs, weight, list(range(1, count + 1)))


def step_size_search(voxels: DataFrame, weight: float, count: int = 10) -> DataFrame:
    """(image_id, alpha0, alpha1): alpha1 = 10^-i by the first drop of the correlation's variation over i = 0 to 10 (1 if
    there is none), alpha0 = alpha1 * ratio by the largest variation of the change; over histories of `count` iterations."""
    checks = list(range(1, count + 1))
    images = voxels.select("image_id").distinct()
    decades = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("run")).withColumn("alpha0", F.pow(F.lit(10.0), -F.col("run")))
    scored = scored_histories(voxels, decades.withColumn("alpha1", F.col("alpha0")), weight, checks).where("metric = 'ncc'")
    intervals = select_step_sizes(scored.select(F.col("image_id").alias("run"), F.col("run").alias("i"), F.col("tv").alias("metric")))
    alpha1 = F.pow(F.lit(10.0), -F.coalesce("interval", F.lit(0))).alias("alpha1")
    chosen = durable(images.join(intervals.withColumnRenamed("run", "image_id"), "image_id", "left").select("image_id", alpha1))
    ratios = F.posexplode(F.array(*map(F.lit, RATIOS))).alias("run", "ratio")
    tried = chosen.select("image_id", "alpha1", ratios).withColumn("alpha0", F.col("alpha1") * F.col("ratio"))
    scored = scored_histories(voxels, tried.drop("ratio"), weight, checks).where("metric = 'change'")
    ratio = F.array(*map(F.lit, RATIOS))[F.col("run")].alias("ratio")
    best = best_ratio(scored.select(F.col("image_id").alias("run"), ratio, F.col("tv").alias("metric")))
    return chosen.join(best.withColumnRenamed("run", "image_id"), "image_id").select("image_id", (F.col("alpha1") * F.col("ratio")).alias("alpha0"), "alpha1")


def downsampling_study(voxels: DataFrame, factors: list[float], orders: list[int], weight: float, iterations: int, width: int, height: int, depth: int = 1) -> DataFrame:
    """(order, factor, image_id, change): for every order and factor, the mean absolute difference of the shading from
    that of the same order at full size."""
    from .solvers import default_alpha, deshade_downsampled

    out = None
    for order in orders:
        solve_at = lambda factor, k=order: deshade_downsampled(voxels, factor, k, default_alpha(k), weight, iterations, width, height, depth).select(*KEY, "shading")
        full = durable(solve_at(1.0))
        for factor in factors:
            both = (full if factor == 1 else solve_at(factor)).join(full.withColumnRenamed("shading", "full"), KEY)
            part = both.groupBy("image_id").agg(F.avg(F.abs(F.col("shading") - F.col("full"))).alias("change"))
            part = part.select(F.lit(order).alias("order"), F.lit(float(factor)).alias("factor"), "image_id", "change")
            out = part if out is None else out.unionByName(part)
    return out
