"""Work on tiles, sweeps, sizes and geometry against plain versions."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import array, image, png

from voxelspark.functions import kernels
from voxelspark.model import KEY, headers
from voxelspark.operators import joins, pixel, segments, solvers, stats, stencils, sweeps, tasks, transforms, windows
from voxelspark.sources import files

TGV2 = kernels.Variation(2, (0.4, 0.8), 0.5)


def noise(*shape, seed=1):
    return np.random.default_rng(seed).normal(size=shape)


def plain_history(f, problem, checks):
    solver = kernels.Solver(problem, len(kernels.axes_of(f)))
    s, before, out = solver.start([f]), None, {}
    for i in range(1, max(checks) + 1):
        s = solver.advance(s)
        if i in checks:
            l = kernels.integrate(solver.split(s)[3])  # noqa: E741
            if before is not None:
                out[i] = (np.corrcoef(l.ravel(), before.ravel())[0, 1] * (l.size - 1) / l.size, np.abs(l - before).sum())
            before = l
    return out


@pytest.mark.parametrize("shape", [(1, 13, 17), (5, 6, 7)])
@pytest.mark.parametrize("size", [6, 64])
def test_histories_of_tiles_and_stacks_are_those_of_whole_images(spark, shape, size):
    f, checks = noise(*shape), [3, 5, 8]
    want = plain_history(f, TGV2, checks)
    tiled = solvers.solve_until(image(spark, f), TGV2, checks, None, halo=4, size=size)[1]
    for df in (tiled, solvers.convergence_history(image(spark, f), TGV2, checks)):
        got = {r.iteration: (r.ncc, r.change) for r in df.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_images_that_are_done_take_no_further_step(spark):
    """Of three images one stops at its second check, which is told by its own rows; the others go on."""
    fs = [noise(1, 9, 11, seed=k) for k in range(3)]
    both = image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)).unionByName(image(spark, fs[2], 2))
    checks = [2, 4, 6]
    for size in (5, 16):
        found, told = solvers.solve_until(both, TGV2, checks, (F.col("image_id") == 1) & (F.col("change") > 0), halo=2, size=size)
        ends = {i: max(r.iteration for r in told.collect() if r.image_id == i) for i in range(3)}
        assert ends == {0: 6, 1: 4, 2: 6}
        for i, f in enumerate(fs):
            assert np.allclose(array(found.where(f"image_id = {i}"), f.shape, "u"), kernels.solve(TGV2, [f], ends[i])[0])
    calls = []
    solvers.solve_until(both, TGV2, checks, lambda i, rows: calls.append(i) or i == 4, size=16)
    assert calls == [4]
    empty = solvers.solve_until(both.limit(0), TGV2, checks, None)
    assert empty[0].count() == empty[1].count() == 0


def test_constant_shadings_have_no_correlation(spark):
    told = solvers.convergence_history(image(spark, np.ones((1, 4, 5))), TGV2, [1, 2, 3], stop=F.col("ncc") > 0.5).collect()
    assert [(r.iteration, r.ncc, r.change) for r in sorted(told)] == [(2, None, 0.0), (3, None, 0.0)]


def test_every_image_has_its_own_numbers(spark):
    fs, numbers = [noise(1, 7, 8, seed=k) for k in range(2)], [(0.3, 0.5, 1.0), (0.9, 1.4, 0.2)]
    both = image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1))
    params = spark.createDataFrame([(i, list(n)) for i, n in enumerate(numbers)], "image_id long, params array<double>")
    for options in ({}, {"whole": 0, "size": 5, "halo": 3}, {"whole": 0, "size": 16}):
        found = solvers.solve_images(both, kernels.Variation(2, (1.0, 1.0), 1.0), 6, params=params, **options)
        for i, (f, (a1, a0, w)) in enumerate(zip(fs, numbers, strict=True)):
            u, v = kernels.solve(kernels.Variation(2, (a1, a0), w), [f], 6)
            own = found.where(f"image_id = {i}")
            assert np.allclose(array(own, f.shape, "u"), u) and np.allclose(array(own, f.shape, "vy"), v[1])


def test_a_failed_run_touches_no_other(spark):
    f, broken = noise(1, 7, 8), noise(1, 7, 8, seed=2)
    broken[0, 3, 3] = np.nan
    ragged = image(spark, f, 2).where("not (x = 2 and y = 2)")
    voxels = image(spark, f, 0).unionByName(image(spark, broken, 1)).unionByName(ragged)
    params = spark.createDataFrame([(0.5, 0.3, 1.0, 0.9), (0.5, 0.0, 1.0, 0.9), (0.5, 0.3, None, 0.9)], "alpha0 double, alpha1 double, weight double, alpha2 double")
    mask = image(spark, (f > 0) * 1.0).crossJoin(spark.range(3).withColumnRenamed("id", "i")).select(F.col("i").alias("image_id"), "x", "y", "z", "value")
    want = solvers.deshade(image(spark, f), kernels.Variation(3, (0.3, 0.5, 0.9), 1.0), 5, image(spark, (f > 0) * 1.0), clamp=True, background=True)
    for options in ({}, {"whole": 0, "size": 5}):
        runs = sweeps.run_sweep(voxels, params, 5, mask, clamp=True, background=True, **options)
        flags = {r.run_id: r.passed for r in runs.select("run_id", "passed").distinct().collect()}
        assert len(flags) == 9 and sum(flags.values()) == 1
        (good,) = [k for k, v in flags.items() if v]
        assert good.startswith("0-") and runs.where("not passed").count() == 8
        own = runs.where(F.col("run_id") == good)
        for c in ("denoised", "shading", "deshaded"):
            assert np.allclose(array(own, f.shape, c), array(want, f.shape, c))
    rows = sweeps.run_rows(runs, params, 5).where("image_id = 0").orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3] and [r.passed for r in rows].count(True) == 1 and rows[0].output_shading_file == "shading_0001.mha"


def flood(value, seeds):
    """Labels by plain floods, seed after seed."""
    label = np.zeros(value.shape, int)
    for segment, _, x, y, z, tolerance in sorted(seeds):
        if not all(0 <= i < n for i, n in zip((z, y, x), value.shape, strict=True)):
            continue
        seen, todo = {(z, y, x)}, deque([(z, y, x)])
        while todo:
            at = todo.popleft()
            for axis in range(3):
                for step in (-1, 1):
                    to = tuple(i + step * (k == axis) for k, i in enumerate(at))
                    if all(0 <= i < n for i, n in zip(to, value.shape, strict=True)) and to not in seen and label[to] == 0 and value[to] < tolerance:
                        seen.add(to)
                        todo.append(to)
        for at in seen:
            label[at] = segment
    return label


@pytest.mark.parametrize("shape,size", [((1, 23, 19), 6), ((6, 9, 11), 4), ((1, 23, 19), 64)])
def test_regions_grow_over_tiles(spark, shape, size):
    rng = np.random.default_rng(4)
    fs = [noise(*shape, seed=k) for k in range(2)]
    seeds = [(1 + k // 2, k % 2, int(rng.integers(shape[2])), int(rng.integers(shape[1])), int(rng.integers(shape[0])), float(rng.choice([0.1, 0.4, 1.0]))) for k in range(5)]
    seeds.append((4, 0, 500, 0, 0, 1.0))  # outside
    table = spark.createDataFrame(seeds, "segment_id int, seed_no int, x int, y int, z int, tolerance double")
    found = segments.region_grow(image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)), table, size)
    for i, f in enumerate(fs):
        own = found.where(f"image_id = {i}")
        want = flood(f, seeds)
        assert np.array_equal(array(own, shape, "label"), want)
        assert own.where("edge").count() == (want > 0).sum() * (shape[0] == 1)
    # With an image_id, a seed belongs to one image.
    one = segments.region_grow(image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)), table.withColumn("image_id", F.lit(1).cast("long")), size)
    assert one.where("image_id = 0 and label > 0").count() == 0 and np.array_equal(array(one.where("image_id = 1"), shape, "label"), flood(fs[1], seeds))


def test_rows_between_tiles_grow_with_faces(spark):
    """A snake through all tiles is one region; a tile has a row for each face, however many voxels it has."""
    a = np.ones((1, 24, 24))
    a[0, ::2, :] = 0
    a[0, 1::4, -1] = 0
    a[0, 3::4, 0] = 0
    seeds = spark.createDataFrame([(1, 0, 0, 0, 0, 0.5)], "segment_id int, seed_no int, x int, y int, z int, tolerance double")
    found = segments.region_grow(image(spark, a), seeds, 6)
    assert np.array_equal(array(found, a.shape, "label"), flood(a, [(1, 0, 0, 0, 0, 0.5)])) and found.where("label = 1").count() == (a == 0).sum()
    tiles = segments.tile(image(spark, a).withColumn("label", F.lit(0.0)), ("value", "label"), 6)
    placed = seeds.withColumns({"image_id": F.lit(0).cast("long"), "seed": F.lit(1)})
    faces = segments._with_seeds(tiles, placed).mapInPandas(segments._meet, segments.FACES)
    assert faces.where("axis >= 0").count() <= 16 * 6


@pytest.mark.parametrize("order", [1, 4])
def test_fields_of_every_order(spark, order):
    row = spark.range(1).select(*(c.alias(f"b{k}") for k, c in enumerate(transforms.basis(F.lit(0.3), order)))).first()
    assert len(row) == order + 1 and sum(row) == pytest.approx(1) and min(row) > 0
    a = (np.mgrid[0:9, 0:9][1] / 8 + 1)[None]
    assert np.abs(array(transforms.bspline_fit(image(spark, a), None, order + 2, 3, order), a.shape) - a).max() < 0.1
    lattice = spark.createDataFrame([(0, x, y, 0, float(v)) for (y, x), v in np.ndenumerate(noise(order + 2, order + 2))], "image_id long, cx long, cy long, cz long, c double")
    grid = image(spark, a).join(headers(image(spark, a)).select("image_id", "width", "height", "depth"), "image_id").drop("value")
    coarse = transforms._evaluated(grid, lattice, 2, order).withColumnRenamed("fit", "value")
    fine = transforms._evaluated(grid, transforms._refined(lattice, headers(image(spark, a)), 2, order), 4, order).withColumnRenamed("fit", "value")
    assert np.allclose(array(coarse, a.shape), array(fine, a.shape))


def test_fields_need_nodes_and_a_level(spark):
    for nodes, levels, order in ((3, 1, 3), (4, 0, 3), (4, 1, 0)):
        with pytest.raises(ValueError, match="order"):
            transforms.bspline_fit(image(spark, np.ones((1, 3, 3))), None, nodes, levels, order)
    far = image(spark, np.ones((1, 9, 9))).withColumn("value", F.when((F.col("x") < 1) & (F.col("y") < 1), 1.0).otherwise(0.0))
    assert transforms.bspline_fit(image(spark, np.ones((1, 9, 9))), far, 10, 1, 1).where("value <> 0").count() < 9


def test_splines_of_lines_in_segments(spark):
    f = noise(1, 2, 300)
    whole, parts = (array(transforms._prefilter(image(spark, f), "x", n), f.shape) for n in (1 << 16, 64))
    assert np.allclose(whole, parts, rtol=0, atol=1e-12) and np.allclose(whole[0, 1], kernels.spline_coefficients(f[0, 1].copy()))


def test_differences_in_cubes(spark):
    f = noise(7, 9, 10)
    for size in (3, 64):
        cubes = windows.in_cubes(image(spark, f), before=True, after=True, size=size)
        assert cubes.where("own").count() == f.size
    d = [np.diff(f, axis=a, append=np.take(f, [-1], axis=a)) for a in (2, 1, 0)]
    found = windows.gradient(image(spark, f))
    assert all(np.allclose(array(found, f.shape, f"v{a}"), x) for a, x in zip("xyz", d, strict=True))
    assert np.allclose(array(windows.div_grad(image(spark, f)), f.shape), array(windows.divergence(found), f.shape))
    tv = stats.image_metrics(image(spark, f)).first()
    assert tv.mean_tv == pytest.approx(sum(np.abs(x) for x in d).mean()) and tv.entropy == pytest.approx(stats.kde_entropy(image(spark, f)).first().entropy)


def unread(df):
    """df, whose voxels must not be read."""
    return df.withColumn("value", F.raise_error(F.lit("read")).cast("double"))


def test_sizes_must_agree(spark):
    a, b = image(spark, noise(1, 4, 5)), image(spark, noise(1, 4, 6))
    with pytest.raises(ValueError, match="differ in size"):
        joins.binary_op(unread(a), unread(b), "add", a_images=headers(a), b_images=headers(b))
    for left, right in ((a, b), (b, a)):
        with pytest.raises(Exception, match="differ in size"):
            joins.binary_op(left, right, "add").collect()
    assert joins.binary_op(a, a, "subtract").where("value <> 0").count() == 0
    assert joins.binary_op(a, a, "subtract", 0.5, a_images=headers(a), b_images=headers(a)).count() == 20
    with pytest.raises(ValueError, match="differ in size"):
        solvers.tgv2_lambda_map(unread(a), unread(b), 1.0, 0.0, 1.0, 1.0, 3, headers(a), headers(b))
    with pytest.raises(ValueError, match="differ in size"):
        solvers.tgv2_lambda_map(a, b, 1.0, 0.0, 1.0, 1.0, 3)
    template = a.select(*KEY, *(F.lit(9).alias(c) for c in "bgr"))
    assert files.with_value_channel(a, template).count() == 20
    with pytest.raises(Exception, match="differ in size"):
        files.with_value_channel(b, template).collect()


def test_boxes_start_inside(spark):
    a = image(spark, noise(1, 4, 5))
    for cut in (lambda: pixel.extract(unread(a), 5, 6, 0, 1, images=headers(a)), lambda: pixel.extract(a, 0, 1, 4, 5), lambda: pixel.extract_header(headers(a), -1, 1, 0, 1)):
        with pytest.raises(ValueError, match="outside"):
            cut()
    assert pixel.extract(a, 3, 9, 2, 9).count() == 4


def test_masks_of_another_size_are_ignored(spark):
    images = image(spark, noise(1, 3, 3), 0).unionByName(image(spark, noise(1, 3, 3), 1))
    masks = image(spark, np.zeros((1, 3, 3)), 0).unionByName(image(spark, np.zeros((1, 2, 3)), 1))
    fit = joins.fitting_mask(masks, headers(images), headers(masks))
    assert joins.inside_mask(images, fit).groupBy("image_id").count().collect() == [(1, 9)]


def test_blur_in_physical_units(spark):
    f = noise(1, 6, 7)
    wide = pixel.set_geometry(headers(image(spark, f)), (0.0,) * 3, (2.0, 2.0, 1.0))
    assert np.allclose(array(stencils.gaussian_blur(image(spark, f), 4.0, images=wide), f.shape), array(stencils.gaussian_blur(image(spark, f), 1.0), f.shape))


def test_colour_files_that_cannot_be_read(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (10, 20, 30)]])
    (tmp_path / "b.png").write_bytes(b"not an image")
    listed = {r.origin.rpartition("/")[2]: (r.width, r.height, r.reason) for r in files.list_color_images(spark, str(tmp_path)).collect()}
    assert listed == {"a.png": (2, 1, None), "b.png": (None, None, "not an image")}
    pixels = files.read_color_images(spark, str(tmp_path))
    assert pixels.count() == 2 and files.write_color_images(pixels, str(tmp_path / "out")).count() == 1
    again = files.read_color_images(spark, str(tmp_path / "out"))
    assert sorted((r.x, r.r, r.g, r.b) for r in again.collect()) == sorted((r.x, r.r, r.g, r.b) for r in pixels.collect())


def test_tasks_without_a_way_do_nothing_and_colours_stay(spark):
    value = np.random.default_rng(3).integers(1, 200, (1, 4, 5)).astype(float)
    voxels = image(spark, value, 4)
    schema = "task_id long, image_id long, mask_id long, mode string, f_downsampling double, `lambda` double, iteration_count int, alpha array<double>"
    listed = spark.createDataFrame([(1, 4, None, "NotMasked", 1.0, 1.0, 3, [1.0, 2.0]), (2, 4, None, "SubtractFromDenoised|Color", 1.0, 1.0, 3, [1.0, 2.0]), (3, 4, None, "SubtractFromDenoised", 1.0, 0.5, 3, [3.0, 2.0])], schema)
    found = tasks.run_tasks(listed, voxels)
    assert {r.image_id for r in found.select("image_id").distinct().collect()} == {2, 3}
    want = solvers.deshade(voxels, kernels.Variation(2, (3.0, 2.0), 0.5), 3, clamp=True)
    assert np.allclose(array(found.where("image_id = 3"), value.shape, "deshaded"), array(want, value.shape, "deshaded"))
    pixels = voxels.select(*KEY, F.col("value").cast("int").alias("b"), F.floor(F.col("value") / 2).cast("int").alias("g"), F.lit(0).alias("r"), "value")
    colours = tasks.color_results(listed, found, pixels)
    assert {r["count"] for r in colours.groupBy("image").count().collect()} == {20} and colours.where("task_id <> 2 or r <> 0 or g > b").count() == 0
    same = colours.where("image = 'input'").select(F.lit(4).cast("long").alias("image_id"), "x", "y", "z", F.col("b").cast("double").alias("value"))
    assert np.array_equal(array(same, value.shape), value)


def test_ratios_that_differ_by_rounding_are_equal(spark):
    scores = spark.createDataFrame([(1, 1.0, 0.5), (1, 1.5, 0.7), (1, 2.0, 0.7 + 1e-14), (2, 1.0, None), (2, 2.0, None), (3, 1.0, -2.0), (3, 2.0, -1.0)], "run long, ratio double, metric double")
    assert {r.run: r.ratio for r in stats.best_ratio(scores).collect()} == {1: 1.5, 2: 1.0, 3: 2.0}


def test_scans_of_large_images_are_those_of_stacks(spark):
    f = image(spark, noise(1, 9, 10))
    alphas = [1.0, 0.1]
    runs = spark.createDataFrame([(0, k, a, a) for k, a in enumerate(alphas)], "image_id long, run int, alpha0 double, alpha1 double")
    key = lambda df: sorted((r.run, r.metric, round(r.tv, 9)) for r in df.collect())
    stacked, tiled = (key(sweeps.scored_histories(f, runs, 1.0, [1, 2, 3, 4, 5], **o)) for o in ({}, {"whole": 0, "size": 6}))
    assert stacked == tiled and len(stacked) == 4
    scan = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 2.0), (1, 1, 3.0)], "image_id long, run int, tv double")
    assert sweeps.decades(scan).collect() == [(0, 1.0)]
