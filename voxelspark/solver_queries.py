"""Registered queries of resampling, downsampled solvers, solvers on tiles and batches, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import solver_sql as ss
from .model import KEY, headers
from .operators import joins, pixel, segments, solvers, stats, stencils, sweeps, tasks, transforms
from .operators.durable import durable, shared_dir
from .registry import add, shown
from .sources import files
from .sources import fixtures as fx

# --- resampling on the grid of enlarged images

FLAT = "SELECT image_id, x, y, 0 AS z, round(value, 6) + 0.0 AS value FROM out"
LINEAR = "CASE WHEN abs(d) < 1 THEN 1 - abs(d) ELSE 0 END"
SINC = "CASE WHEN abs(d) < 1e-12 THEN 1 WHEN abs(d) >= 4 THEN 0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) END"
WIDER = "o * n / ( m + 2)::DOUBLE"
for _name, _weight, _low, _high in (("linear", LINEAR, 0, 1), ("sinc", SINC, -3, 4)):
    add(
        f"x7_resize_{_name}_enlarged",
        lambda s, d, m=_name: transforms.resize(fx.img8(s, d), 1.5, m),
        FLAT,
        fx.IMG8,
        ss.resampled("img8", "out", 8, 8, _weight, _low, _high, 12, 12, WIDER),
    )
for _factor, _size in ((0.5, 4), (1.5, 12)):
    add(
        f"x7_resize_bspline3_{str(_factor).replace('.', '_')}",
        lambda s, d, f=_factor: transforms.resize(fx.img8(s, d), f, "bspline3"),
        FLAT,
        fx.IMG8,
        ss.splined("img8", "out", (8, 8), (_size, _size)),
    )

# --- shading removal on reduced images: images with values of both signs, and a mask


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' images, less their means."""
    return transforms.remove_zero_frequency(fx.event_raster(spark, sf_dir))


SIGNED = "signed AS MATERIALIZED (SELECT image_id, x, y, z, value - avg(value) OVER (PARTITION BY image_id) AS value FROM raster)"
ABOVE = "above AS MATERIALIZED (SELECT image_id, x, y, z, CASE WHEN value > avg(value) OVER (PARTITION BY image_id) THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM signed)"


def reduced_tables(source: str, factor: float, alpha: tuple[float, ...], weight: float, iterations: int, kind: str, p: str = "") -> list[str]:
    """`large_u` and `large_l`, after the prefix p: denoised image and shading of the source, 24 x 30, solved at the factor.
    kind: plain, masked or not_masked; the latter two by the mask `above`."""
    size = (24, 30) if factor == 1 else (math.ceil(24 * factor), math.ceil(30 * factor))
    cut = f"(SELECT s.image_id, s.x, s.y, s.value * a.value AS value FROM {source} s JOIN above a USING (image_id, x, y))" if kind == "masked" else source
    plain, last = kind == "plain", f"WHERE it = {iterations}"
    if factor == 1:
        out = [f"{p}small_f AS MATERIALIZED (SELECT image_id, x, y, value FROM {cut})"]
        out += [] if plain else [f"{p}small_m AS MATERIALIZED (SELECT image_id, x, y, value FROM above)"]
    else:
        out = [ss.splined(cut, f"{p}small_f", (24, 30), size)]
        out += [] if plain else [ss.splined("above", f"{p}raw_m", (24, 30), size), f"{p}small_m AS MATERIALIZED (SELECT image_id, x, y, round(value, 9) AS value FROM {p}raw_m)"]
    of = f"{p}small_f f" if plain else f"{p}small_f f JOIN {p}small_m m USING (image_id, x, y)"
    out.append(f"{p}both_f AS MATERIALIZED (SELECT image_id, x, y, 0 AS z, f.value{'' if plain else ', m.value AS m'} FROM {of})")
    out.append(ss.variation(f"{p}both_f", 2, len(alpha), alpha, weight, iterations, mask="m" if kind == "masked" else None, name=f"{p}st"))
    out.append(ss.integrated(f"{p}st", *size, name=f"{p}shading", extra=last))
    out.append(f"{p}small_u AS MATERIALIZED (SELECT image_id, x, y, u AS value FROM {p}st {last})")
    cut_shading = f"SELECT image_id, x, y, h.value * m.value AS value FROM {p}shading h JOIN {p}small_m m USING (image_id, x, y)"
    out.append(f"{p}small_l AS MATERIALIZED ({f'SELECT image_id, x, y, value FROM {p}shading' if plain else cut_shading})")
    if factor == 1:
        return [*out, *(f"{p}large_{c} AS MATERIALIZED (SELECT * FROM {p}small_{c})" for c in "ul")]
    return [*out, *(ss.splined(f"{p}small_{c}", f"{p}large_{c}", size, (24, 30)) for c in "ul")]


_MASKED_TABLES = (fx.EVENTS, SIGNED, ABOVE)
_REDUCED = """
SELECT s.image_id, s.x, s.y, 0 AS z, round(u.value, 6) + 0.0 AS denoised, round({shading}, 6) + 0.0 AS shading, round({deshaded}, 6) + 0.0 AS deshaded
FROM signed s JOIN large_u u USING (image_id, x, y) JOIN large_l l USING (image_id, x, y) JOIN above a ON (a.image_id, a.x, a.y) = (s.image_id, s.x, s.y)"""
_KINDS = {
    "": ("plain", "l.value", "s.value - l.value"),
    "_masked": ("masked", "l.value * a.value", "greatest(0, (s.value * a.value - l.value) * a.value + s.value * (1 - a.value))"),
    "_not_masked": ("not_masked", "l.value", "greatest(0, (s.value - l.value) * a.value + s.value * (1 - a.value))"),
}


def _downsampled(factor: float, kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        image = signed(s, d)
        options = {} if kind == "plain" else {"mask": fx.mask_of(image), "clamp": True, "background": True, "masked": kind == "masked"}
        return solvers.deshade_downsampled(image, factor, 2, (1.0, 2.0), 0.5, 50, 24, 30, 1, **options)

    return run


for _suffix, (_kind, _shading, _deshaded) in _KINDS.items():
    add(f"i11_deshade_downsampled{_suffix}", _downsampled(0.5, _kind), _REDUCED.format(shading=_shading, deshaded=_deshaded), *_MASKED_TABLES, *reduced_tables("signed", 0.5, (1.0, 2.0), 0.5, 50, _kind))
add("i11_deshade_downsampled_factor_1", _downsampled(1.0, "masked"), _REDUCED.format(shading=_KINDS["_masked"][1], deshaded=_KINDS["_masked"][2]), *_MASKED_TABLES, *reduced_tables("signed", 1.0, (1.0, 2.0), 0.5, 50, "masked"))


def _signed_deshaded(s: SparkSession, d: str) -> DataFrame:
    image = signed(s, d)
    return solvers.deshade(image, solvers.Variation(2, (1.0, 2.0), 0.5), 50, fx.mask_of(image), clamp=True, background=True)


add(
    "i9_deshade_background_signed",
    _signed_deshaded,
    """
SELECT s.image_id, s.x, s.y, s.z, round(s.u, 6) + 0.0 AS denoised, round(h.value * a.value, 6) + 0.0 AS shading,
       round(greatest((s.u - h.value) * a.value, 0) + s.u * (1 - a.value), 6) + 0.0 AS deshaded
FROM st s JOIN shading h USING (image_id, x, y) JOIN above a ON (a.image_id, a.x, a.y) = (s.image_id, s.x, s.y) WHERE s.it = 50""",
    fx.EVENTS,
    SIGNED,
    ABOVE,
    ss.variation("signed", 2, 2, (1.0, 2.0), 0.5, 50),
    ss.integrated("st", 24, 30, extra="WHERE it = 50"),
)

# --- tiles: four images of 64 x a quarter of the vectors; the third check ends those whose shading hardly changes

_LINES = "(SELECT max(y) + 1 FROM strips)"
_CHECKS, _SIMILAR = [4, 8, 12, 16], 0.95
_TGV2 = solvers.Variation(2, (0.02, 0.04), 1.0)
_HISTORY = f"""told AS MATERIALIZED (
  SELECT image_id, it AS iteration, covar_pop(value, before) / (stddev_samp(value) * stddev_samp(before)) AS ncc, sum(abs(value - before)) AS change
  FROM (SELECT *, lag(value) OVER (PARTITION BY image_id, x, y ORDER BY it) AS before FROM shading) WHERE it > 4 GROUP BY image_id, it),
ends AS MATERIALIZED (SELECT image_id, coalesce(min(iteration) FILTER (ncc > {_SIMILAR}), 16) AS last FROM told GROUP BY image_id)"""
_STRIPS = (fx.STRIPS.format(4), ss.variation("strips", 2, 2, _TGV2.alpha, 1.0, 16), ss.integrated("st", 64, _LINES, key="image_id, it", extra="WHERE it IN (4, 8, 12, 16)"), _HISTORY)


def _until(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return solvers.solve_until(fx.strips(s, d, 4), _TGV2, _CHECKS, F.col("ncc") > _SIMILAR, halo=4, size=48)


add("i12_history_until_similar", lambda s, d: _until(s, d)[1], "SELECT image_id, iteration, round(ncc, 6) + 0.0 AS ncc, round(change, 6) + 0.0 AS change FROM told JOIN ends USING (image_id) WHERE iteration <= last", *_STRIPS)
add(
    "u3_tiles_until_similar",
    lambda s, d: _until(s, d)[0],
    "SELECT s.image_id, s.x, s.y, s.z, round(u, 6) + 0.0 AS u, round(v0, 6) + 0.0 AS vx, round(v1, 6) + 0.0 AS vy, 0.0::DOUBLE AS vz FROM st s JOIN ends USING (image_id) WHERE it = last",
    *_STRIPS,
)

# --- sweeps: every image, larger than a tile, with every parameter set; a set without a sense fails by itself

_SETS = ((0.02, 0.01, 1.0), (0.04, 0.01, 1.0), (0.04, 0.02, 0.5), (0.04, 0.0, 1.0))


def _grid(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(_SETS), "alpha0 double, alpha1 double, weight double")


def _tiled(s: SparkSession, d: str) -> DataFrame:
    image = fx.strips(s, d, 2)
    return sweeps.run_sweep(image, _grid(s), 8, fx.mask_of(image), clamp=True, background=True, whole=0, halo=4, size=48)


_NUMBERED = "sets AS (SELECT *, row_number() OVER (ORDER BY a0, a1, weight) - 1 AS n FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)" for a, b, w in _SETS) + ") AS t(a0, a1, weight))"
_SWEPT = "swept AS MATERIALIZED (SELECT image_id, image_id || '-' || n AS run_id, x, y, z, value, a0, a1, weight FROM strips CROSS JOIN sets WHERE a1 > 0)"
_CUT = "cut AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN value > avg(value) OVER (PARTITION BY image_id) THEN 1.0::DOUBLE ELSE 0.0 END AS m FROM strips)"
add(
    "b1_run_sweep_tiled",
    _tiled,
    """
SELECT s.image_id, run_id, s.x, s.y, s.z, round(s.u, 6) + 0.0 AS denoised, round(h.value * m, 6) + 0.0 AS shading,
       round(greatest(0, (s.u - h.value) * m) + s.u * (1 - m), 6) + 0.0 AS deshaded, true AS passed
FROM st s JOIN shading h USING (image_id, run_id, x, y) JOIN cut ON (cut.image_id, cut.x, cut.y) = (s.image_id, s.x, s.y) WHERE s.it = 8
UNION ALL SELECT i, i || '-' || n, 0, 0, 0, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM sets CROSS JOIN range(2) AS r(i) WHERE a1 <= 0""",
    fx.STRIPS.format(2),
    _NUMBERED,
    _SWEPT,
    _CUT,
    ss.variation("swept", 2, 2, ("a1", "a0"), "weight", 8, key="image_id, run_id"),
    ss.integrated("st", 64, _LINES, key="image_id, run_id", extra="WHERE it = 8"),
)
add(
    "b1_run_rows",
    lambda s, d: sweeps.run_rows(_tiled(s, d), _grid(s), 8),
    """
SELECT i AS image_id, CAST(k AS INTEGER) AS id, i || '-' || n AS run_id, a0 AS alpha0, a1 AS alpha1, weight, 8 AS iteration_count, a1 > 0 AS passed,
       printf('denoised_%04d.mha', k) AS output_denoised_file, printf('shading_%04d.mha', k) AS output_shading_file, printf('deshaded_%04d.mha', k) AS output_deshaded_file
FROM (SELECT *, row_number() OVER (ORDER BY a1, a0, weight) AS k FROM sets) CROSS JOIN (SELECT DISTINCT vec_id % 2 AS i FROM embeddings)""",
    _NUMBERED,
)

# --- region growing over tiles: large regions, seeds inside the regions of others, one seed on a high voxel

_SEEDS = ((1, 0, 10, 10, 0, 0.05), (1, 1, 40, 60, 0, 0.05), (2, 0, 50, 90, 0, 0.02), (2, 1, 11, 10, 0, 0.3), (3, 0, 30, 30, 0, 0.1))


def _grown(s: SparkSession, d: str) -> DataFrame:
    seeds = s.createDataFrame(list(_SEEDS), "segment_id int, seed_no int, x int, y int, z int, tolerance double")
    return segments.region_grow(fx.strips(s, d, 4), seeds, size=24)


add(
    "i15_region_grow_tiled",
    _grown,
    """
SELECT image_id, x, y, z, coalesce(label, 0) AS label, coalesce(label, 0) > 0 AS edge
FROM strips LEFT JOIN (SELECT image_id, x, y, z, max_by(label, seed) AS label FROM ("""
    + " UNION ALL ".join(f"SELECT *, {g} AS label, {i} AS seed FROM g{i}" for i, (g, *_) in enumerate(_SEEDS, 1))
    + ") GROUP BY ALL) USING (image_id, x, y, z)",
    fx.STRIPS.format(4),
    ss.grown("strips", tuple((g, x, y, z, t) for g, _, x, y, z, t in _SEEDS)),
)

# --- smooth fields: cubic ones with a mask, and each other order

_SEEN = "seen AS MATERIALIZED (SELECT a.image_id, a.x, a.y, a.value FROM img8 a JOIN mask8 m USING (image_id, x, y, z) WHERE m.value <> 0)"
_FIT = "SELECT image_id, x, y, 0 AS z, round(value, 6) + 0.0 AS value FROM fit"
add(
    "x10_bspline_fit",
    lambda s, d: transforms.bspline_fit(fx.img8(s, d), fx.mask_of(fx.img8(s, d)), 4, 2),
    _FIT,
    fx.IMG8,
    fx.MASK8,
    _SEEN,
    ss.fitted("img8", "seen", 8, 4, 3, 2),
)
for _order in (1, 2, 4, 5):
    add(
        f"x10_bspline_fit_order_{_order}",
        lambda s, d, k=_order: transforms.bspline_fit(fx.img8(s, d), None, k + 2, 2, k),
        _FIT,
        fx.IMG8,
        ss.fitted("img8", "(SELECT image_id, x, y, value FROM img8)", 8, _order + 2, _order, 2),
    )

# --- geometry: spacings other than 1, different from image to image


def _spaced(s: SparkSession, d: str) -> DataFrame:
    """Headers of img8: odd images have spacings 0.5 and 2, all start at (1, -1, 0)."""
    odd = F.col("image_id") % 2 == 1
    images = pixel.set_geometry(headers(fx.img8(s, d)), (1.0, -1.0, 0.0), (1.0, 1.0, 1.0))
    return images.withColumns({"sx": F.when(odd, 0.5).otherwise(1.0), "sy": F.when(odd, 2.0).otherwise(1.0)})


_SX, _SY = "CASE WHEN image_id % 2 = 1 THEN 0.5::DOUBLE ELSE 1 END", "CASE WHEN image_id % 2 = 1 THEN 2.0::DOUBLE ELSE 1 END"
add(
    "a1_image_information_geometry",
    lambda s, d: stats.image_information(fx.img8(s, d), _spaced(s, d)).drop("sd", "variance", "cv", "sum_abs"),
    f"""
SELECT image_id, 8 AS width, 8 AS height, 1 AS depth, count(*) AS voxel_count, round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS min,
       round(max(value), 6) + 0.0 AS max, round(sum(value * value), 6) + 0.0 AS sum_sq, 1.0::DOUBLE AS ox, -1.0::DOUBLE AS oy, 0.0::DOUBLE AS oz, {_SX} AS sx, {_SY} AS sy, 1.0::DOUBLE AS sz
FROM img8 GROUP BY image_id""",
)


def _blurred_sql(axis: str, source: str, out: str, odd: float) -> str:
    """`out`: source blurred along an axis of 8, with the variance 1 in even images and `odd` in odd ones."""
    tables = {k: stencils.gaussian_weights(v, 32) for k, v in ((0, 1.0), (1, odd))}
    rows = ", ".join(f"({k}, {i - len(w) // 2}, {x!r}::DOUBLE)" for k, w in tables.items() for i, x in enumerate(w))
    cols = ", ".join(f"CAST(t.o AS INTEGER) AS {c}" if c == axis else f"p.{c}" for c in "xyz")
    return f"""{out} AS MATERIALIZED (SELECT p.image_id, {cols}, sum(p.value * k.w) AS value
  FROM (VALUES {rows}) AS k(odd, i, w) CROSS JOIN range(8) AS t(o) JOIN {source} p ON p.image_id % 2 = k.odd AND p.{axis} = greatest(0, least(7, t.o + k.i)) GROUP BY ALL)"""


add(
    "n10_gaussian_blur_spacing",
    lambda s, d: stencils.gaussian_blur(fx.img8(s, d), 1.0, 32, _spaced(s, d)),
    shown("value", "blur_y"),
    fx.IMG8,
    _blurred_sql("x", "img8", "blur_x", 4.0),
    _blurred_sql("y", "blur_x", "blur_y", 0.25),
)
for _factor, _new, _pad in ((0.5, 4, 0), (1.5, 12, 2)):
    add(
        f"x7_resized_header_{str(_factor).replace('.', '_')}",
        lambda s, d, f=_factor: transforms.resized_header(_spaced(s, d), f),
        f"""
SELECT vec_id AS image_id, {_new} AS width, {_new} AS height, 1 AS depth, 1.0::DOUBLE AS ox, -1.0::DOUBLE AS oy, 0.0::DOUBLE AS oz,
       round(({_SX.replace("image_id", "vec_id")}) * 8 / {_new + _pad}, 6) + 0.0 AS sx, round(({_SY.replace("image_id", "vec_id")}) * 8 / {_new + _pad}, 6) + 0.0 AS sy, round(1 / {1 + _pad}.0::DOUBLE, 6) + 0.0 AS sz
FROM embeddings""",
        fx.IMG8,
    )
add(
    "p12_extract_header_geometry",
    lambda s, d: pixel.extract_header(_spaced(s, d), 2, 5, 1, 9),
    f"""
SELECT vec_id AS image_id, 4 AS width, 7 AS height, 1 AS depth, 1 + 2 * ({_SX.replace("image_id", "vec_id")}) AS ox, -1 + ({_SY.replace("image_id", "vec_id")}) AS oy, 0.0::DOUBLE AS oz,
       {_SX.replace("image_id", "vec_id")} AS sx, {_SY.replace("image_id", "vec_id")} AS sy, 1.0::DOUBLE AS sz
FROM embeddings""",
)

# --- masks of another size are ignored


def _inside_fitting(s: SparkSession, d: str) -> DataFrame:
    """img8 inside masks of which every third is whole and the others are cut to smaller boxes."""
    image, at = fx.img8(s, d), F.col("image_id")
    mask = fx.mask_of(image).where((at % 3 == 0) | ((F.col("x") <= at % 7) & (F.col("y") <= at % 5)))
    return joins.inside_mask(image, joins.fitting_mask(mask, headers(image), headers(mask)))


add(
    "j7_inside_fitting_mask",
    _inside_fitting,
    "SELECT i.image_id, i.x, i.y, i.z, round(i.value, 6) + 0.0 AS value FROM img8 i JOIN mask8 m USING (image_id, x, y, z) WHERE i.image_id % 3 <> 0 OR m.value <> 0",
    fx.IMG8,
    fx.MASK8,
)

# --- colour files, written and read back, and a file among them that is no image


def colours(s: SparkSession, d: str) -> DataFrame:
    """(KEY, b, g, r) from img8 and its partners."""
    byte = lambda c: F.floor(F.least(F.lit(255.0), F.abs(c) * 400)).cast("int")
    both = fx.img8(s, d).join(fx.pair8(s, d).withColumnRenamed("value", "other"), KEY)
    return both.select(*KEY, byte(F.col("value")).alias("b"), byte(F.col("other")).alias("g"), byte(F.col("value") + F.col("other")).alias("r"))


def _read_back(s: SparkSession, d: str) -> DataFrame:
    good, bad = shared_dir(s), shared_dir(s)
    files.write_color_images(colours(s, d), good)
    s.createDataFrame([("no image",)], "value string").coalesce(1).write.text(bad)
    name = F.coalesce(F.nullif(F.regexp_extract("origin", r"(\d+)\.png$", 1), F.lit("")), F.lit("broken")).alias("name")
    decoded = files.decode_color_images(s, good, bad)
    listed = files.list_color_images(s, decoded=decoded).select(name, "image_id", "width", "height", "reason")
    pixels = files.read_color_images(s, decoded=decoded).select("image_id", "x", "y", "b", "g", "r", "value")
    return listed.join(pixels, "image_id", "left").drop("image_id")


_BYTE = "CAST(floor(least(255.0::DOUBLE, abs({}) * 400)) AS INTEGER)"
COLOURS = f"""colours AS MATERIALIZED (SELECT a.image_id, a.x, a.y, {_BYTE.format('a.value')} AS b, {_BYTE.format('p.value')} AS g, {_BYTE.format('a.value + p.value')} AS r
  FROM img8 a JOIN pair8 p USING (image_id, x, y, z))"""
add(
    "s1_write_read_color_images",
    _read_back,
    """
SELECT CAST(image_id AS VARCHAR) AS name, 8 AS width, 8 AS height, NULL AS reason, x, y, b, g, r, greatest(b, g, r)::DOUBLE AS value FROM colours
UNION ALL SELECT 'broken', NULL, NULL, 'not an image', NULL, NULL, NULL, NULL, NULL, NULL""",
    fx.IMG8,
    fx.PAIR8,
    COLOURS,
)

# --- the downsampling study: 3 orders at 3 factors against the same order at full size

_FACTORS, _ORDERS = (1.0, 0.5, 0.25), (2, 3, 4)
_STUDY = [(k, f, f"o{k}f{round(1 / f)}_") for k in _ORDERS for f in _FACTORS]
_STUDIED = " UNION ALL ".join(
    f"SELECT {k} AS \"order\", {f}::DOUBLE AS factor, image_id, round(avg(abs(l.value - w.value)), 6) + 0.0 AS change FROM {p}large_l l JOIN o{k}f1_large_l w USING (image_id, x, y) GROUP BY image_id" for k, f, p in _STUDY
)
add(
    "b3_downsampling_study",
    lambda s, d: sweeps.downsampling_study(fx.event_raster(s, d), list(_FACTORS), list(_ORDERS), 0.5, 20, 24, 30),
    _STUDIED,
    fx.EVENTS,
    *(t for k, f, p in _STUDY for t in reduced_tables("raster", f, solvers.default_alpha(k), 0.5, 20, "plain", p)),
)

# --- tasks on colour files: hue and saturation stay, the value channel is solved


def _color_tasks(s: SparkSession, d: str) -> DataFrame:
    folder = shared_dir(s)
    files.write_color_images(colours(s, d), folder)
    pixels = durable(files.read_color_images(s, folder).withColumn("name", F.regexp_extract("origin", r"(\d+)\.png$", 1)))
    ids = pixels.select("name", "image_id").distinct()
    listed = ids.select(
        F.col("name").cast("long").alias("task_id"), F.col("name").alias("input"), F.lit("none").alias("mask"), F.lit("SubtractFromDenoised|NotMasked|Color").alias("mode"),
        F.lit(1.0).alias("f_downsampling"), F.lit(0.5).alias("lambda"), F.lit(20).alias("iteration_count"), F.array(F.lit(3.0), F.lit(6.0)).alias("alpha"),
    )
    bound = durable(tasks.bind_tasks(listed, ids))
    results = durable(tasks.run_tasks(bound, pixels.select(*KEY, "value")))
    return tasks.color_results(bound, results, pixels)


_SHADE = "CAST(trunc(CASE WHEN most = 0 THEN v ELSE {0} * v / most END) AS INTEGER) AS {0}"
add(
    "b2_color_tasks",
    _color_tasks,
    f"""
SELECT image_id AS task_id, image, x, y, 0 AS z, {', '.join(_SHADE.format(c) for c in 'bgr')}
FROM (SELECT image_id, image, x, y, b::DOUBLE AS b, g::DOUBLE AS g, r::DOUBLE AS r, greatest(b, g, r)::DOUBLE AS most, greatest(0, least(255, value)) AS v
      FROM colours JOIN (SELECT image_id, x, y, 'input' AS image, value FROM channel UNION ALL SELECT image_id, x, y, 'denoised', u FROM st WHERE it = 20
                         UNION ALL SELECT image_id, x, y, 'deshaded', greatest(0, s.u - h.value) FROM st s JOIN shading h USING (image_id, x, y) WHERE it = 20) USING (image_id, x, y))""",
    fx.IMG8,
    fx.PAIR8,
    COLOURS,
    "channel AS MATERIALIZED (SELECT image_id, x, y, 0 AS z, greatest(b, g, r)::DOUBLE AS value FROM colours)",
    ss.variation("channel", 2, 2, (3.0, 6.0), 0.5, 20),
    ss.integrated("st", 8, 8, extra="WHERE it = 20"),
)

# --- scans of alpha: convergence histories of every image, with alpha0 = alpha1 and with ratios of both


def scanned(rows: str, p: str = "", source: str = "img8") -> list[str]:
    """`tvs`(image_id, run, metric, tv), after the prefix p: the variation of the histories of the source's images over ten
    iterations; rows: (run, a0, a1), which may use what the source has of an image."""
    return [
        f"{p}scans AS MATERIALIZED (SELECT image_id, x, y, z, value, run, a0, a1 FROM {source} CROSS JOIN LATERAL ({rows}) r)",
        ss.variation(f"{p}scans", 2, 2, ("a1", "a0"), 1.0, 10, key="image_id, run", name=f"{p}st"),
        ss.integrated(f"{p}st", 8, 8, key="image_id, run, it", name=f"{p}shading", extra="WHERE it > 0"),
        f"""{p}told AS MATERIALIZED (SELECT image_id, run, it, covar_pop(value, before) / nullif(stddev_samp(value) * stddev_samp(before), 0) AS ncc, sum(abs(value - before)) AS change
  FROM (SELECT *, lag(value) OVER (PARTITION BY image_id, run, x, y ORDER BY it) AS before FROM {p}shading) WHERE it > 1 GROUP BY image_id, run, it)""",
        f"""{p}tvs AS MATERIALIZED (SELECT image_id, run, metric, sum(step) AS tv FROM (SELECT image_id, run, metric, it, abs(lead(value) OVER (PARTITION BY image_id, run, metric ORDER BY it) - value) AS step
  FROM (SELECT image_id, run, it, 'ncc' AS metric, ncc AS value FROM {p}told UNION ALL SELECT image_id, run, it, 'change', change FROM {p}told)) WHERE it < 9 GROUP BY ALL)""",
    ]


_SCAN = "SELECT image_id, CAST(run AS INTEGER) AS run, round(a0, 6) + 0.0 AS alpha0, round(a1, 6) + 0.0 AS alpha1, metric, round(tv, 6) + 0.0 AS tv FROM tvs JOIN (SELECT DISTINCT run, a0, a1 FROM scans) USING (run)"
add(
    "b4_equal_alpha_scan",
    lambda s, d: sweeps.equal_alpha_scan(fx.img8(s, d), [10.0**-i for i in range(9)]),
    _SCAN,
    fx.IMG8,
    *scanned("SELECT run, power(10.0::DOUBLE, -run) AS a0, power(10.0::DOUBLE, -run) AS a1 FROM range(9) AS r(run)"),
)
_RATIOS = ", ".join(f"({i}, {r}::DOUBLE)" for i, r in enumerate(stats.SCAN_RATIOS))
add(
    "b4_ratio_scan",
    lambda s, d: sweeps.ratio_scan(fx.img8(s, d), fx.img8(s, d).select("image_id").distinct().withColumn("alpha1", F.lit(0.01))),
    _SCAN,
    fx.IMG8,
    *scanned(f"SELECT run, 0.01::DOUBLE * ratio AS a0, 0.01::DOUBLE AS a1 FROM (VALUES {_RATIOS}) AS r(run, ratio)"),
)
add(
    "a6_correlation_one_mean",
    lambda s, d: stats.normalized_cross_correlation(fx.img8(s, d), fx.positive(fx.pair8(s, d)), one_mean=True),
    """
SELECT image_id, round(sum((a - m) * (b - m)) / (sqrt(sum((a - m) ** 2) / (count(*) - 1)) * sqrt(sum((b - m) ** 2) / (count(*) - 1)) * count(*)), 6) + 0.0 AS ncc
FROM (SELECT image_id, a.value AS a, b.value AS b, avg(a.value) OVER (PARTITION BY image_id) AS m FROM img8 a JOIN ppair8 b USING (image_id, x, y, z)) GROUP BY image_id""",
    fx.IMG8,
    fx.PAIR8,
    "ppair8 AS (SELECT image_id, x, y, z, value - min(value) OVER (PARTITION BY image_id) + 1 AS value FROM pair8)",
)

# --- the search of step sizes: a decade by the first drop of the correlation's variation, then a ratio

_TRIED = ", ".join(f"({i}, {r}::DOUBLE)" for i, r in enumerate(stats.RATIOS))
_DROPS = """drops AS (SELECT image_id, min(run) - 1 AS i FROM (
  SELECT *, lag(tv) OVER (PARTITION BY image_id ORDER BY run) AS before FROM d_tvs WHERE metric = 'ncc') WHERE tv < before - 1e-9 * abs(before) GROUP BY image_id),
chosen AS MATERIALIZED (SELECT v.*, power(10.0::DOUBLE, -coalesce(i, 0)) AS alpha1 FROM img8 v LEFT JOIN drops USING (image_id))"""
add(
    "k3_step_size_search",
    lambda s, d: sweeps.step_size_search(fx.img8(s, d), 1.0),
    """
SELECT image_id, round(min(a0), 6) + 0.0 AS alpha0, round(min(a1), 6) + 0.0 AS alpha1
FROM (SELECT *, max(tv) OVER (PARTITION BY image_id) AS top FROM r_tvs WHERE metric = 'change') JOIN (SELECT DISTINCT image_id, run, a0, a1 FROM r_scans) USING (image_id, run)
WHERE tv >= top - 1e-9 * abs(top) GROUP BY image_id""",
    fx.IMG8,
    *scanned("SELECT run, power(10.0::DOUBLE, -run) AS a0, power(10.0::DOUBLE, -run) AS a1 FROM range(11) AS r(run)", "d_"),
    _DROPS,
    *scanned(f"SELECT run, alpha1 * ratio AS a0, alpha1 AS a1 FROM (VALUES {_TRIED}) AS t(run, ratio)", "r_", "chosen"),
)
