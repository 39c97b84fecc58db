"""What the planner makes of rows that become many: no voxels and no taps are broadcast."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_images import array, image

from voxelspark import model
from voxelspark.functions import kernels
from voxelspark.model import headers
from voxelspark.operators import lines, pixel, products, segments, solvers, stencils, sweeps, transforms
from voxelspark.sources import files, fixtures

RNG = np.random.default_rng(3)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_images(monkeypatch):
    """Any number of images counts as many."""
    monkeypatch.setattr(model, "MOST_IMAGES", 0)


def test_neighbours_and_convolutions_broadcast_nothing_of_many_images(spark, many_images):
    f = RNG.normal(size=(3, 4, 5))
    df = image(spark, f)
    near = stencils.neighbours(df, headers(df), in_slice=False)
    soft = stencils.convolve(df, stencils.preset("laplace", True), dynamic_centre=True)
    assert "Broadcast" not in plan(near) and "Broadcast" not in plan(soft)
    assert near.count() == np.prod([3 * n - 2 for n in f.shape])


@pytest.mark.parametrize("name", ["non_local_gradient", "bilateral"])
def test_neighbourhoods_of_small_kernels_move_voxels_once(spark, name):
    fs = [RNG.normal(size=s) for s in ((3, 4, 5), (3, 4, 5), (1, 6, 7))]
    df = image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)).unionByName(image(spark, fs[2], 2))
    args = (3, 2.0) if name == "non_local_gradient" else (3, 2.0, 0.5)
    out = getattr(stencils, name)(df, *args, wide=False)
    assert "Join" not in plan(out) and "Generate explode" not in plan(out)
    for i, f in enumerate(fs):
        assert np.allclose(array(out.where(f"image_id = {i}"), f.shape), getattr(kernels, name)(f, *args))


@pytest.mark.parametrize("name", ["non_local_gradient", "bilateral"])
def test_neighbourhoods_of_images_with_holes_leave_these_out(spark, name):
    f = RNG.normal(size=(1, 4, 5))
    args = (3, 2.0) if name == "non_local_gradient" else (3, 2.0, 0.5)
    df = image(spark, f).where("not (x = 2 and y = 2)")
    out = getattr(stencils, name)(df, *args, wide=False)
    assert "SortMergeJoin" in plan(out)
    got = {(r.x, r.y): r.value for r in out.collect()}
    assert len(got) == 19 and np.isclose(got[0, 0], getattr(kernels, name)(f[:, :2, :2], *args)[0, 0, 0])


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic", "bspline3", "sinc", "area"])
def test_resizing_of_many_images_broadcasts_nothing_and_makes_no_row_of_a_tap(spark, many_images, method):
    f = RNG.normal(size=(1, 6, 7))
    out = transforms.resize(image(spark, f), 1.5, method, pad=0)
    assert "Broadcast" not in plan(out) and "to#" not in plan(out)
    assert out.count() == 9 * 11


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic", "bspline3", "sinc", "area"])
@pytest.mark.parametrize("m", [13, 40, 90])
def test_lines_in_segments_are_those_made_whole(spark, method, m):
    f = RNG.normal(size=(1, 2, 40))
    images = headers(image(spark, f)).selectExpr("image_id", "width n", f"{m} m", "2D pad")
    taps = lambda n, m, own, to: transforms._resize_taps(method, n, m, own[0], to)
    scale = "m / n" if method == "cubic" else "(m + pad) / n"
    parts, whole = (array(lines.along(image(spark, f), images, "x", taps, 4, ("pad",), scale, True, segment=s), (1, 2, m)) for s in (7, 1 << 16))
    assert np.allclose(parts, whole, rtol=0, atol=1e-13)


def test_lines_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 4.0), (1, 2, 0, 0, None), (1, 3, 0, 0, 8.0), (1, 9, 0, 0, 5.0)], "image_id long, x int, y int, z int, value double")
    images = spark.sql("SELECT 1L image_id, 12 width, 1 height, 1 depth")
    got = {r.x: r.value for r in transforms.resize(df, 2.0, "linear", images, pad=0).where("y = 0").collect()}
    assert got[0] == 4 and got[1] == 4 and got[2] is None and got[5] == 4 and got[6] == 8 and 8 not in got and got[18] == 5


def test_blurs_of_many_images_broadcast_nothing(spark, many_images):
    f = RNG.normal(size=(1, 4, 5)) ** 2
    for out in (stencils.gaussian_blur(image(spark, f), 1.0), stencils.unsharp_mask(image(spark, f), 32, 1.0, 0.7), stencils.multiscale_retinex(image(spark, f), [(1.0, 2.0), (2.0, 1.0)])):
        assert "Broadcast" not in plan(out) and "to#" not in plan(out)
        assert out.count() == 20


@pytest.mark.parametrize("shape", [(1, 7, 9), (5, 6, 7)])
def test_fields_need_no_row_of_a_control_point_and_voxel(spark, many_images, monkeypatch, shape):
    """Also with bricks smaller than the image, and more control points than are broadcast."""
    f = RNG.normal(size=shape)
    whole = array(transforms.bspline_fit(image(spark, f), None, 5, 2, 3), shape)
    monkeypatch.setattr(transforms, "BRICK", 4)
    monkeypatch.setattr(transforms, "MOST_POINTS", 0)
    out = transforms.bspline_fit(image(spark, f), None, 5, 2, 3)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert np.allclose(array(out, shape), whole, rtol=0, atol=1e-12)


def test_fields_of_null_voxels_and_of_none(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 4.0), (1, 1, 0, 0, None), (1, 2, 0, 0, 4.0), (2, 0, 0, 0, None), (2, 1, 0, 0, None)], "image_id long, x int, y int, z int, value double")
    got = {(r.image_id, r.x): r.value for r in transforms.bspline_fit(df, None, 4, 1).collect()}
    assert len(got) == 5 and 0 < got[1, 0] <= 4 and got[2, 0] == 0


def test_sums_of_cells_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 560.21] * 500
    one = lambda vs: spark.createDataFrame([(v,) for v in vs], "v double").coalesce(1).agg(fixtures.exact_sum(F.col("v"))).first()[0]
    assert one(values) == one(sorted(values)) == one(sorted(values)[::-1]) == 280405.0
    assert np.isnan(one([1.0, np.nan])) and one([1.0, 1e300]) == 1e300 and one([None, 2.0]) == 2 and one([None]) is None


def test_files_are_listed_by_so_many_at_a_time(spark, tmp_path, monkeypatch):
    """Seven images and two files that are none, three at a time, as read in one go: not from a folder below."""
    grid = [(k, x, y, 0, 10 * k, x, y) for k in range(7) for y in range(2) for x in range(3)]
    pixels = spark.createDataFrame(grid, "image_id long, x int, y int, z int, b int, g int, r int")
    for folder in (tmp_path / "images", tmp_path / "images" / "below"):
        files.write_color_images(pixels, str(folder))
    (tmp_path / "images" / "broken.png").write_text("no image")
    (tmp_path / "images" / "_hidden.png").write_text("no image")
    (tmp_path / "other.png").write_text("no image")
    paths = str(tmp_path / "images"), str(tmp_path / "oth*.png")
    rows = lambda df: sorted(map(repr, df.collect()))
    whole = [rows(f(spark, *paths)) for f in (files.list_color_images, files.read_color_images)]
    assert [len(x) for x in whole] == [9, 42]
    monkeypatch.setattr(files, "FILES", 3)
    asked = []
    listed = files.islice
    monkeypatch.setattr(files, "islice", lambda names, n: asked.append(n) or listed(names, n))
    assert [rows(f(spark, *paths)) for f in (files.list_color_images, files.read_color_images)] == whole
    assert asked and set(asked) == {3}


def test_polygons_are_looked_up_where_the_voxels_are(spark, monkeypatch):
    images = headers(image(spark, RNG.normal(size=(2, 8, 9))))
    square = [(0, i, float(x), float(y), 1) for i, (x, y) in enumerate([(1, 1), (6, 1), (6, 5), (1, 5)])]
    hole = [(1, i, float(x), float(y), 0) for i, (x, y) in enumerate([(2, 2), (2, 4), (4, 4), (4, 2)])]
    drawn = spark.createDataFrame(square + hole, "poly_id int, vertex int, x double, y double, slice int")
    mask = pixel.polygon_mask(images, drawn)
    assert "SortMergeJoin" not in plan(mask)
    rows = {(r.x, r.y, r.z) for r in mask.where("value = 1").collect()}
    assert rows == {(x, y, 1) for x in range(1, 6) for y in range(1, 5)} | {(x, y, 0) for x in range(2, 4) for y in range(2, 4)}
    monkeypatch.setattr(pixel, "BROADCAST_CROSSINGS", 0)
    assert {(r.x, r.y, r.z) for r in pixel.polygon_mask(images, drawn).where("value = 1").collect()} == rows and mask.count() == 144


def _matrix(spark, n: int, rows: int, cols: int):
    some = lambda most: int(RNG.integers(most)) if RNG.random() > 0.02 else None
    found = [(some(rows), some(cols), float(RNG.normal()) if RNG.random() > 0.05 else None) for _ in range(n)]
    return spark.createDataFrame(found, "row long, col long, val double")


@pytest.mark.parametrize("sizes", [(1 << 19, 1 << 20, 1 << 21), (300, 400, 500)])
def test_matrix_products_shuffle_entries_and_not_terms(spark, sizes):
    a, b = _matrix(spark, 1200, 40, 50), _matrix(spark, 1200, 50, 30)
    terms = a.join(b.select(F.col("row").alias("col"), F.col("col").alias("to"), F.col("val").alias("v")), "col")
    want = {(r["row"], r.to): r.val for r in terms.groupBy("row", "to").agg(F.sum(F.col("val") * F.col("v")).alias("val")).collect()}
    out = products.product(a, b, *sizes)
    got = [((r["row"], r["col"]), r.val) for r in out.collect()]
    assert len(got) == len(want) and {k for k, v in got if v is None} == {k for k, v in want.items() if v is None}
    assert all(v is None or np.isclose(v, want[k]) for k, v in got)
    assert "HashAggregate" not in plan(solvers.matrix_multiply(a, b)).split("FlatMapGroups")[0] and out.where("false").count() == 0


def test_small_images_take_poisson_steps_in_stacks(spark, monkeypatch):
    fs = [RNG.normal(size=s) for s in ((3, 4, 5), (1, 6, 7), (3, 4, 5))]
    fs = [f - f.mean() for f in fs]
    df = image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)).unionByName(image(spark, fs[2], 2))
    holed = df.unionByName(image(spark, fs[1], 3).where("x + y > 0"))
    key = lambda out: {(r.image_id, r.x, r.y, r.z): r.value for r in out.collect()}
    want = key(solvers.solve_poisson_cg(holed, steps=6, whole=0))
    mixed = key(solvers.solve_poisson_cg(holed, steps=6))
    tables = []
    old = solvers._poisson_tables
    monkeypatch.setattr(solvers, "_poisson_tables", lambda *args: tables.append(1) or old(*args))
    got = key(solvers.solve_poisson_cg(df, steps=6))
    assert not tables and mixed.keys() == want.keys() and got.keys() == {k for k in want if k[0] < 3}
    assert all(np.isclose(v, want[k], atol=1e-9) for found in (mixed, got) for k, v in found.items())


def test_conjugate_gradients_keep_the_matrix_in_blocks_of_columns(spark, monkeypatch):
    monkeypatch.setattr(solvers, "ENTRIES", 60)
    n = 20
    a = RNG.normal(size=(n, n)) * (RNG.random((n, n)) < 0.5)
    a = a + a.T + 4 * n * np.eye(n)
    at = [(int(i), int(j), float(a[i, j]) / 2) for i, j in zip(*np.nonzero(a), strict=True)]
    f = RNG.normal(size=n)
    vector = spark.createDataFrame([(i, float(v)) for i, v in enumerate(f)], "i long, val double")
    matrix = spark.createDataFrame(at + at, "row long, col long, val double")
    kept, _ = solvers._in_blocks(matrix)
    assert kept.select("block").distinct().count() > 3
    assert kept.groupBy("col").agg(F.countDistinct("block").alias("n")).where("n > 1").isEmpty()
    got = {r.i: r.val for r in solvers.cg_solve(matrix, vector, 1e-20).collect()}
    assert np.allclose([got[i] for i in range(n)], np.linalg.solve(a, f), atol=1e-8)


def test_regions_of_many_images_grow_without_broadcasts(spark, monkeypatch):
    """Only the seeds' own table is broadcast; parts, faces and the lists of tiles are not, however small their files are."""
    f = RNG.normal(size=(1, 12, 13))
    seeds = spark.createDataFrame([(1, 0, 2, 2, 0, 0.8), (2, 0, 9, 9, 0, 0.5)], "segment_id int, seed_no int, x int, y int, z int, tolerance double")
    plans, old = [], segments.durable
    monkeypatch.setattr(model, "MOST_IMAGES", -1)  # an empty table is many, too
    monkeypatch.setattr(segments, "durable", lambda df: plans.append(plan(df)) or old(df))
    grown = segments.region_grow(image(spark, f), seeds, size=4)
    assert len(plans) > 9 and not [p for p in [*plans, plan(grown)] if "Broadcast" in p and "BroadcastNestedLoopJoin" not in p]
    whole = segments.region_grow(image(spark, f), seeds)
    rows = lambda df: sorted((r.x, r.y, r.label) for r in df.collect())
    assert rows(grown) == rows(whole) and grown.where("label > 0").count() > 20


def test_runs_are_scored_where_their_images_are(spark, monkeypatch):
    """Runs and voxels are not joined, and what is null or not a number takes no part; in slices as at once."""
    fs = [RNG.normal(size=(1, 6, 7)), RNG.normal(size=(3, 4, 5)), RNG.normal(size=(1, 6, 7))]
    df = image(spark, fs[0], 0).unionByName(image(spark, fs[1], 1)).unionByName(image(spark, fs[2], 2))
    runs = spark.createDataFrame([(i, k, a, 2 * a) for i in (0, 1, 2, 5) for k, a in enumerate((1.0, 0.1, 0.01)) if i + k != 2], "image_id long, run int, alpha0 double, alpha1 double")
    scored = sweeps.scored_histories(df, runs, 1.0, [1, 2, 3, 5])
    assert "Join" not in plan(scored)
    rows = lambda out: {(r.image_id, r.run, r.alpha0, r.alpha1, r.metric): r.tv for r in out.collect()}
    whole, tiled = rows(scored), rows(sweeps.scored_histories(df, runs, 1.0, [1, 2, 3, 5], whole=0))
    assert len(whole) == 12 and whole.keys() == tiled.keys() and all(np.isclose(v, tiled[k], atol=1e-9) for k, v in whole.items())
    assert solvers._varied(np.array([[1.0, np.nan, 3.0, 5.0, 9.0], [1.0, 2.0, 4.0, 4.0, 0.0]])).tolist() == [2.0, 3.0]


def test_stacks_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(solvers, "SLICE", 50)
    f = RNG.normal(size=(5, 1, 4, 6))
    rows = pd.DataFrame([(i, x, y, z, f[i, z, y, x]) for i, z, y, x in np.ndindex(f.shape)], columns=["image_id", "x", "y", "z", "value"]).sample(frac=1, random_state=1).reset_index(drop=True)
    parts = [a for _, (a,) in solvers.stacks(rows, ["value"])]
    assert [len(a) for a in parts] == [2, 2, 1] and (np.concatenate(parts) == f).all()


def test_tasks_hold_a_stack_or_an_image_at_a_time(spark, monkeypatch):
    """Whatever a task has to do, only some images of it are there at once; batches cut images anywhere."""
    monkeypatch.setattr(solvers, "SLICE", 50)
    sizes = [24, 24, 24, 7, 130, 1, 24, 60, 24, 24, 3]
    ids = np.repeat(np.arange(len(sizes)) * 5, sizes)
    rows = pd.DataFrame({"image_id": ids, "value": np.arange(len(ids))})
    for batch in (1, 24, 40, 1000):
        parts = list(solvers.whole_images(rows.iloc[a : a + batch] for a in range(0, len(rows) + batch, batch)))
        assert pd.concat(parts, ignore_index=True).equals(rows) and all((p.index == range(len(p))).all() for p in parts)
        assert sum(p["image_id"].nunique() for p in parts) == len(sizes)
        assert batch == 1000 or max(map(len, parts)) <= 130 + 50 + batch and len(parts) > 3
    assert not list(solvers.whole_images(iter([])))


def test_stacks_of_many_images_are_streams_and_not_groups(spark):
    """More voxels than one stack in each task, of two sizes."""
    flat = spark.range(3000).selectExpr("id AS image_id", "explode(sequence(0, 63)) AS i").selectExpr("image_id", "i % 8 AS x", "i div 8 AS y", "0 AS z", "image_id + i / 64.0D AS value")
    deep = spark.range(3000, 3100).selectExpr("id AS image_id", "explode(sequence(0, 23)) AS i").selectExpr("image_id", "i % 2 AS x", "i div 2 % 3 AS y", "i div 6 AS z", "image_id + i / 64.0D AS value")
    df = flat.unionByName(deep).selectExpr("image_id", *(f"CAST({a} AS int) AS {a}" for a in "xyz"), "value").repartition(7, "x", "y")
    means = solvers.by_stacks(df, ["value"], lambda fields: {"mean": np.broadcast_to(fields[0].mean(axis=(1, 2, 3), keepdims=True), fields[0].shape), "same": fields[0]}, ["mean", "same"])
    assert "FlatMapGroups" not in plan(means)
    met = means.join(df, ["image_id", "x", "y", "z"])
    wrong = met.where("same <> value OR abs(mean - image_id - IF(image_id < 3000, 31.5, 11.5) / 64) > 1e-6")
    assert means.count() == met.count() == 3000 * 64 + 100 * 24 and wrong.isEmpty()
    problem = kernels.Variation(2, (1.0, 2.0), 1.0)
    told = solvers.convergence_history(df, problem, [1, 2, 3])
    assert "FlatMapGroups" not in plan(told) and told.count() == 2 * 3100 and told.select("image_id", "iteration").distinct().count() == 2 * 3100
    assert "FlatMapGroups" not in plan(solvers.tgvk_l1(df, 1.0, 3, solvers.default_alpha(3), 2))


def test_bricks_are_fitted_some_at_a_time(monkeypatch):
    """What a task holds of a batch is bounded by voxels times weights, not by rows; parts give the numbers of the whole."""
    import pyarrow as pa

    from voxelspark.operators import transforms

    rng, cells = np.random.default_rng(1), np.indices((8, 8)).reshape(2, -1).astype(np.int32)
    one = {"x": cells[1].tolist(), "y": cells[0].tolist(), "z": [0] * 64}
    rows = [{"image_id": i, "width": 8, "height": 8, "depth": 1} | one | {"value": rng.random(64).tolist()} for i in range(40)]
    ints = [(c, pa.int32()) for c in ("width", "height", "depth")] + [(c, pa.list_(pa.int32())) for c in "xyz"]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.int64()), *ints, ("value", pa.list_(pa.float64()))]))

    class Bricks:
        def mapInArrow(self, run, schema):
            return run

    held, told = [], []

    def work(part, row, taps, squares, most):
        held.append(len(row))
        for k, (i, w) in enumerate(taps):
            told.append((k, (i * w / squares)[:64].sum()))
        yield part

    for weights, most in ((1 << 21, 2560), (3 * 7 * 64 * 4, 256), (1, 64)):
        monkeypatch.setattr(transforms, "WEIGHTS", weights)
        held.clear()
        told.clear()
        list(transforms._on_bricks(Bricks(), 4, 5, work, "")(iter([batch])))
        assert max(held) == most and sum(held) == 2560
        assert [k for k, _ in told[:36]] == list(range(36)) and len({round(v, 12) for k, v in told if k == 7}) == 1


def test_states_of_tiles_go_to_python_some_at_a_time(spark, monkeypatch):
    """Every exchange, and what is read from the last states, hands TILES rows at most to Python; before, thousands."""
    from voxelspark.operators import tiles

    name, told, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], tiles.durable
    before = spark.conf.get(name)
    monkeypatch.setattr(tiles, "durable", lambda df: told.append(int(spark.conf.get(name))) or real(df))
    voxels = image(spark, RNG.normal(size=(1, 5, 13)))
    problem = kernels.Variation(2, (0.5, 1.0), 1.0)
    got = solvers.solve_images(voxels, problem, 2, whole=0, halo=1, size=4)
    assert len(told) == 3 and set(told) == {tiles.TILES} and spark.conf.get(name) == before
    want = solvers.solve_images(voxels, problem, 2).orderBy("y", "x").toPandas()
    np.testing.assert_allclose(got.orderBy("y", "x").toPandas()[["u", "vx", "vy"]], want[["u", "vx", "vy"]], atol=1e-12)


def test_colour_files_are_listed_without_hadoop_and_decoded_once(spark, tmp_path):
    """Hadoop would start a process for each local file; hidden files and folders that are no partitions do not count."""
    for name in ("a.png", "k=1/b.png", "k=1/l=2/c.png", "_hidden.png", ".dot.png", "plain/d.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(files._png(np.full((2, 3, 3), 7, np.uint8)))
    assert sorted(files._local(str(tmp_path))) == ["/a.png", "/k=1/b.png", "/k=1/l=2/c.png"]
    assert sorted(files._listed(spark, str(tmp_path))) == [f"file:{tmp_path}{n}" for n in ("/a.png", "/k=1/b.png", "/k=1/l=2/c.png")]
    assert list(files._listed(spark, str(tmp_path / "a.png"))) == [f"file:{tmp_path}/a.png"]
    folder = str(tmp_path / "k=1" / "l=2")
    decoded = files.decode_color_images(spark, folder)
    for f in (files.list_color_images, files.read_color_images):
        assert f(spark, decoded=decoded).collect() == f(spark, folder).collect()
