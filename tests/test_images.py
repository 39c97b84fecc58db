"""Tiles against whole images, solvers, segments, files and sweeps."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark import queries
from voxelspark.functions import kernels
from voxelspark.model import KEY
from voxelspark.operators import joins, pixel, segments, solvers, stats, stencils, sweeps, tasks, transforms, windows
from voxelspark.operators.tiles import by_blocks
from voxelspark.sources import fields, files

RNG = np.random.default_rng(11)


def image(spark, a, image_id=0):
    rows = [(image_id, int(x), int(y), int(z), float(v)) for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, z int, value double")


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


@pytest.mark.parametrize("shape,problem", [((1, 13, 17), kernels.Variation(2, (0.4, 0.8), 0.5)), ((6, 7, 9), kernels.Variation(3, (0.4, 0.8, 1.2), 0.5))])
def test_tiles_give_what_the_whole_image_gives(spark, shape, problem):
    f = RNG.normal(size=shape)
    u, v = kernels.solve(problem, [f], 9)
    found = solvers.solve_images(image(spark, f), problem, 9, whole=0, halo=4, size=6)
    assert np.allclose(array(found, shape, "u"), u, atol=1e-12) and np.allclose(array(found, shape, "vx"), v[0], atol=1e-12)


def test_blocks_give_what_the_whole_image_gives(spark):
    a = RNG.normal(size=(3, 11, 12))
    f = lambda x: kernels.bilateral(x, 4, 3.0, 0.5)
    assert np.allclose(array(by_blocks(image(spark, a), f, halo=3, size=5), a.shape), f(a))


def test_shading_is_recovered(spark):
    truth = np.zeros((1, 16, 16))
    truth[0, 4:12, 4:12] = 1.0
    bias = image(spark, np.zeros((1, 16, 16))).select(*KEY, (0.02 * F.col("x")).alias("value"))
    out = solvers.deshade(joins.add(image(spark, truth), bias), kernels.Variation(2, (1.0, 4.0), 1.0), 400)
    shading = array(out, truth.shape, "shading")
    assert np.ptp(shading) > 0.1 and np.allclose(array(out, truth.shape, "denoised") - shading, array(out, truth.shape, "deshaded"))


def test_conjugate_gradients_agree_with_cosine_transforms(spark):
    a = RNG.normal(size=(1, 5, 6))
    f = image(spark, a - a.mean())
    x, y = array(solvers.solve_poisson_cg(f, 1e-18, 40), a.shape), array(transforms.solve_poisson(f), a.shape)
    assert np.allclose(x - x.mean(), y, atol=1e-6)


def test_cg_solves_a_sparse_system(spark):
    m = spark.createDataFrame([(i, j, 4.0 if i == j else -1.0) for i in range(8) for j in range(8) if abs(i - j) <= 1], "row long, col long, val double")
    f = spark.createDataFrame([(i, float(i)) for i in range(8)], "i long, val double")
    x = solvers.cg_solve(m, f, 1e-24, steps=8)
    assert np.allclose([r.val for r in solvers.spmv(m, x).orderBy("i").collect()], range(8))


def test_regions_grow_through_low_values(spark):
    a = np.ones((1, 5, 5))
    a[0, 1, :] = 0
    a[0, 3, 1:] = 0
    seeds = spark.createDataFrame([(1, "a", 0, 0, 1, 0, 0.5), (2, "b", 0, 4, 3, 0, 0.5), (2, "b", 1, 2, 1, 0, 0.5)], "segment_id int, name string, seed_no int, x int, y int, z int, tolerance double")
    labels = array(segments.region_grow(image(spark, a), seeds), a.shape, "label")
    want = np.zeros((1, 5, 5))
    want[0, 1, :] = 1
    want[0, 3, 1:] = 2
    want[0, 1, 2] = 2  # a seed takes its own voxel
    assert np.array_equal(labels, want)


def test_constant_and_tiny_images(spark):
    one, flat = image(spark, np.full((1, 1, 1), 2.0)), image(spark, np.full((2, 3, 4), 5.0))
    for v in (one, flat):
        assert {r.value for r in pixel.rescale(v, 0, 1).collect()} == {0.0}
        assert stats.kde_entropy(v).first().entropy == 0.0 and stats.total_variation(v).first().tv == 0.0
        assert {r.value for r in windows.div_grad(v).collect()} == {0.0}
        assert np.allclose([r.value for r in transforms.idct(transforms.dct(v)).collect()], [r.value for r in v.collect()])
    assert stats.histogram(flat, 4, 5.0, 9.0).where("bin = 0").first().probability == 1.0
    empty_mask = flat.withColumn("value", F.lit(0.0))
    assert joins.inside_mask(flat, empty_mask).count() == 0


def test_blur_keeps_a_constant_and_the_weights_sum_to_one(spark):
    assert sum(stencils.gaussian_weights(2.0, 32)) == pytest.approx(1)
    assert np.allclose([r.value for r in stencils.gaussian_blur(image(spark, np.full((1, 3, 4), 7.0)), 2.0).collect()], 7)


def test_pixel_log_by_ieee(spark):
    got = [r.v for r in spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "v double").select(pixel.log(F.col("v")).alias("v")).collect()]
    assert got[0] == 0 and got[1] == -np.inf and np.isnan(got[2])


def png(path, rows):
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_colour_files(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (10, 20, 30), (0, 0, 0)], [(1, 2, 3), (0, 200, 7), (9, 9, 9)]])
    seen = files.read_color_images(spark, str(tmp_path))
    assert np.array_equal(array(seen, (1, 2, 3)), [[[255, 30, 0], [3, 200, 9]]])
    doubled = files.with_value_channel(seen.select(*KEY, (F.col("value") * 2).alias("value")), seen).where("x = 1 and y = 0").first()
    assert (doubled.r, doubled.g, doubled.b) == (20, 40, 60)


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0.5\n\nliver: 1|2|0<0.25; 3|4|0;\nbone:7|8|0<1;\n")
    seeds = files.read_seeds(spark, str(tmp_path / "s.txt"))
    rows = [tuple(r) for r in seeds.orderBy("segment_id", "seed_no").collect()]
    assert rows == [(1, "liver", 0, 1, 2, 0, 0.25), (1, "liver", 1, 3, 4, 0, 0.5), (2, "bone", 0, 7, 8, 0, 1.0)]
    files.write_seeds(seeds, str(tmp_path / "out"), 0.5)
    assert [tuple(r) for r in files.read_seeds(spark, str(tmp_path / "out")).orderBy("segment_id", "seed_no").collect()] == rows


def test_task_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# comment\n\ndir; a.png; m.png; Color; [1, 2, 0]; [3, 4, 0]; 0.5; 2; 100; [1, 2.5]\n")
    r = files.read_tasks(spark, str(tmp_path / "t.txt")).collect()
    assert len(r) == 1 and r[0].alpha == [1.0, 2.5] and r[0].line_start == [1.0, 2.0, 0.0] and r[0].iteration_count == 100


def test_tasks_give_what_the_single_operators_give(spark):
    a = RNG.random((1, 6, 7))
    both = image(spark, a, 4).unionByName(image(spark, (a > 0.3) * 1.0, 5))
    names = spark.createDataFrame([("i", 4), ("m", 5)], "name string, image_id long")
    row = lambda task, mask, mode: (task, "i", mask, mode, [0.0, 0.0, 0.0], [6.0, 5.0, 0.0], 0.5, 1.0, 5, [1.0, 4.0])
    schema = "task_id long, input string, mask string, mode string, line_start array<double>, line_end array<double>, f_downsampling double, `lambda` double, iteration_count int, alpha array<double>"
    listed = spark.createDataFrame([row(1, "m", "SubtractFromDenoised"), row(2, "m", "SubtractFromInput|NotMasked"), row(3, "none", "SubtractFromDenoised|NotMasked"), row(4, "m", "SubtractFromDenoised|NotMasked")], schema)
    bound = tasks.bind_tasks(listed, names)
    found = tasks.run_tasks(bound, both)
    source, mask = image(spark, a, 4), image(spark, (a > 0.3) * 1.0, 4)
    after = {"clamp": True, "background": True}
    problem = kernels.Variation(2, (1.0, 4.0), 1.0)
    wanted = {
        1: solvers.deshade_masked(source, mask, 2, (1.0, 4.0), 1.0, 5, **after),
        2: solvers.deshade_downsampled(source, 0.5, 2, (1.0, 4.0), 1.0, 5, 7, 6, 1, mask, **after, masked=False),
        3: solvers.deshade(source, problem, 5, **after),
        4: solvers.deshade(source, problem, 5, mask, **after),
    }
    for task, df in wanted.items():
        assert np.allclose(array(found.where(f"image_id = {task}"), a.shape, "deshaded"), array(df, a.shape, "deshaded"), atol=1e-9)
    judged = tasks.evaluate_tasks(bound, both, found, 4, 0.0, 1.0)
    counts = {(r.task_id, r.kind): r["count"] for r in judged.groupBy("task_id", "kind").count().collect()}
    assert counts == {(t, k): n for t in wanted for k, n in (("change", 3), ("histogram", 8), ("profile", 14))}
    start = judged.where("task_id = 1 and kind = 'profile' and image = 'input' and item = '0'").first()
    assert start.value == a[0, 0, 0] and start["at"] == 0
    assert tasks.run_tasks(bound.where("false"), both).count() == 0
    with pytest.raises(Exception, match="no image of this name"):
        tasks.bind_tasks(listed.withColumn("input", F.lit("gone")), names).collect()


def test_sweeps_and_run_tables(spark, tmp_path):
    img = image(spark, RNG.random((1, 6, 6)))
    runs = sweeps.run_sweep(img, sweeps.parameter_grid(spark, [0.5, 1.0], None), 10)
    assert runs.count() == 72 and runs.where("passed").count() == 72
    evaluated = sweeps.evaluate_runs(img, runs)
    assert evaluated.count() == 2 and sweeps.best_runs(evaluated).count() == 1
    table = spark.createDataFrame([(1, 0.1, 5.0), (2, 0.2, 3.0), (3, 0.3, 3.0)], "id long, alpha0 double, metric double")
    files.insert_runs(table, str(tmp_path / "runs"))
    assert stats.select_minimum(spark.read.parquet(str(tmp_path / "runs")), "metric", "alpha0").first().id == 2
    files.export_columns(table, ["alpha0", "metric"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=" ", header=True).count() == 3


def test_bias_fields(spark):
    ramp = [r.value for r in fields.make_linear_bias(spark, 8).collect()]
    assert min(ramp) == pytest.approx(0.1) and max(ramp) == pytest.approx(0.9)
    z = [r.value for r in fields.make_z_field(spark, 8).collect()]
    assert min(z) == 0 and max(z) == 1 and len(z) == 64


def test_a_fitted_field_is_smooth_and_near(spark):
    y, x = np.mgrid[0:12, 0:12]
    a = (np.sin(x / 5) + y / 12)[None]
    fit = array(transforms.bspline_fit(image(spark, a), None, 6, 3), a.shape)
    assert np.abs(fit - a).max() < 0.1


def test_sparse_queries_on_whole_keys(spark, sf_dir):
    """No key is folded or left out: every order and part of lineitem has its rows, with the sums of plain loops."""
    lines = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_discount").collect()]
    price = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    both, y = defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for a, b, v in lines:
        for i, j in ((a, b), (b, a)):
            both[i][j] += v
            if j in price:
                y[i] += v * price[j]
    got = {r.i: r.val for r in queries.queries()["i14_spmv_whole"](spark, sf_dir).collect()}
    assert got.keys() == y.keys() and len(got) > 1000 and all(got[i] == pytest.approx(y[i], abs=1e-5) for i in y)
    product = defaultdict(float)
    for a, b, v in lines:
        for j, w in both[b].items():
            product[a, j] += 2 * v * w
    found = {(r.row, r.col): r.val for r in queries.queries()["i14_matrix_multiply_whole"](spark, sf_dir).collect()}
    assert found.keys() == product.keys() and all(found[k] == pytest.approx(product[k], abs=1e-5) for k in product)


def test_cg_says_when_it_stops_early(spark, sf_dir):
    m = spark.createDataFrame([(i, i, float(i + 1)) for i in range(6)], "row long, col long, val double")
    f = spark.createDataFrame([(i, 1.0) for i in range(6)], "i long, val double")
    with pytest.warns(UserWarning, match="conjugate gradients"):
        solvers.cg_solve(m, f, steps=2)
    assert np.allclose([r.val for r in solvers.cg_solve(m, f, 1e-16, steps=6).orderBy("i").collect()], 1 / np.arange(1, 7))
    assert queries.queries()["i14_cg_solve"](spark, sf_dir).count() > 1000


def test_step_sizes_of_convergence_histories(spark):
    shapes = [RNG.random((1, 6, 6)), np.ones((1, 6, 6))]
    found = {r.image_id: r for r in sweeps.step_size_search(image(spark, shapes[0]).unionByName(image(spark, shapes[1], 1)), 1.0).collect()}

    def variation(f, alpha0, alpha1, name):
        solver = kernels.Solver(kernels.Variation(2, (alpha1, alpha0), 1.0), 2)
        s, seen = solver.start([f]), []
        for _ in range(10):
            s = solver.advance(s)
            seen.append(kernels.integrate(solver.split(s)[3]))
        pairs = list(zip(seen, seen[1:], strict=False))
        values = [np.abs(b - a).sum() if name == "change" else np.corrcoef(a.ravel(), b.ravel())[0, 1] * 35 / 36 for a, b in pairs]
        return np.abs(np.diff(values))[:-1].sum()

    tv = [variation(shapes[0], 10.0**-i, 10.0**-i, "ncc") for i in range(11)]
    alpha1 = 10.0 ** -next((i - 1 for i in range(1, 11) if tv[i] < tv[i - 1]), 0)
    ratio = max(stats.RATIOS, key=lambda r: variation(shapes[0], alpha1 * r, alpha1, "change"))
    assert (found[0].alpha0, found[0].alpha1) == (pytest.approx(alpha1 * ratio), pytest.approx(alpha1))
    assert (found[1].alpha0, found[1].alpha1) == (1.0, 1.0)


def test_lines_of_any_length_equal_their_cosine_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 64, 4099):
        v, k = rng.normal(size=(2, n)), np.arange(min(n, 50))
        sums = v @ np.cos(np.pi * np.outer(np.arange(n) + 0.5, k) / n)
        assert np.allclose(transforms.dct_lines(v)[:, : len(k)], sums)
        assert np.allclose(transforms.idct_lines(transforms.dct_lines(v)), v)


def test_transform_of_images_with_missing_and_null_voxels(spark):
    rows = [(1, 0, 0, 0, 2.0), (1, 2, 0, 0, None), (1, 2, 1, 0, -1.0), (2, 0, 0, 0, 5.0)]
    v = spark.createDataFrame(rows, "image_id long, x int, y int, z int, value double")
    out = {(r.image_id, r.x, r.y): r.value for r in transforms.dct(v).collect()}
    for x in range(3):
        for y in range(2):
            want = 8 * (2 * np.cos(np.pi * 0.5 * x / 3) * np.cos(np.pi * 0.5 * y / 2) - np.cos(np.pi * 2.5 * x / 3) * np.cos(np.pi * 1.5 * y / 2))
            assert np.isclose(out.pop((1, x, y)), want)
    assert out == {(2, 0, 0): 40.0}
    assert transforms.dct(v.limit(0)).count() == 0
