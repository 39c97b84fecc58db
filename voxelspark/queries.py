"""Registered queries of the image operators, and the SQL that gives the same rows.

Values are rounded to six places and 0.0 is added on both sides, so that -0.0 and the order of sums do not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.kernels import Variation
from .model import KEY, dense_grid, headers, is_dense, map_voxels, zip_voxels
from . import solver_queries, solver_sql as ss  # noqa: F401  solver_queries registers its own
from .operators import joins, pixel, segments, solvers, stats, stencils, sweeps, tasks, transforms, windows
from .operators.durable import durable, shared_dir
from .registry import QUERIES, SQL, Query
from .registry import add as _add
from .sources import fields, files
from .sources import fixtures as fx

def _voxelwise(name: str, f: Callable[[Column], Column], sql: str, source=fx.img8, *tables: str, of: str = "img8") -> None:
    _add(name, lambda s, d: map_voxels(source(s, d), f), f"SELECT image_id, x, y, z, round({sql}, 6) + 0.0 AS value FROM {of}", *tables)


def _positive8(s: SparkSession, d: str) -> DataFrame:
    return fx.positive(fx.img8(s, d))


def _mask8(s: SparkSession, d: str) -> DataFrame:
    return fx.mask_of(fx.img8(s, d))


def _values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


V = "SELECT image_id, x, y, z, round({}, 6) + 0.0 AS value FROM "
I8 = "SELECT image_id, {} FROM img8 GROUP BY image_id"

RAGGED = "ragged AS (SELECT * FROM img8 WHERE image_id % 3 = 0 OR (x <= image_id % 8 AND y <= image_id % 5))"


def _ragged(s: SparkSession, d: str) -> DataFrame:
    """img8 cut to boxes of different sizes."""
    at = F.col("image_id")
    return fx.img8(s, d).where((at % 3 == 0) | ((F.col("x") <= at % 8) & (F.col("y") <= at % 5)))


# --- sources

_add("s2_voxels_from_array", fx.vol4, V.format("value") + "vol4", fx.VOL4)
_add("s3_rasterize_events", fx.event_raster, V.format("value") + "raster", fx.EVENTS)
_add("s3_rasterize_sales", fx.sales_volume, V.format("value") + "sales", fx.SALES)
_add("s4_quantize", lambda s, d: files.quantize(fx.event_raster(s, d), 65535), """
SELECT image_id, x, y, z, CAST(trunc(CASE WHEN hi = lo THEN 0 ELSE (value - lo) * (65535.0::DOUBLE / (hi - lo)) END) AS INTEGER) AS value
FROM raster JOIN (SELECT image_id, min(value) AS lo, max(value) AS hi FROM raster GROUP BY image_id) USING (image_id)""", fx.EVENTS)
_add("s10_apply_bias", lambda s, d: fields.apply_bias(fx.img8(s, d), map_voxels(fx.pair8(s, d), F.abs), "multiply"), """
SELECT image_id, x, y, z, round(CASE WHEN hi = lo THEN 0 ELSE (p - lo) / (hi - lo) END, 6) + 0.0 AS value
FROM (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi
      FROM (SELECT a.image_id, a.x, a.y, a.z, a.value * abs(b.value) AS p FROM img8 a JOIN pair8 b USING (image_id, x, y, z))
      WINDOW w AS (PARTITION BY image_id))""", fx.IMG8, fx.PAIR8)

# --- projections

_voxelwise("p1_invert", pixel.invert, "1 - value")
_voxelwise("p2_binarize", pixel.binarize, "CASE WHEN abs(value) > 1e-7 THEN 1.0::DOUBLE ELSE 0.0 END")
_voxelwise("p3_log", pixel.log, "ln(value)", _positive8, fx.IMG8, fx.POS8, of="pos8")
_voxelwise("p4_exp", F.exp, "exp(value)")
_voxelwise("p5_add_constant", lambda v: v + 0.25, "value + 0.25")
_voxelwise("p6_multiply_constant", lambda v: v * 3.5, "value * 3.5")
_voxelwise("p7_clamp_negative", lambda v: pixel.clamp_negative(v, 0.0), "CASE WHEN value < 0 THEN 0.0::DOUBLE ELSE value END")
_voxelwise("p8_threshold", lambda v: pixel.threshold(v, -0.1, 0.1, -1.0), "CASE WHEN value BETWEEN -0.1 AND 0.1 THEN value ELSE -1.0::DOUBLE END")
_voxelwise("p9_clamp", lambda v: pixel.clamp(v, -0.1, 0.1), "greatest(-0.1::DOUBLE, least(value, 0.1::DOUBLE))")
_voxelwise("p17_shrink", lambda v: pixel.shrink(v, 0.05), "CASE WHEN abs(value) > 1e-6 AND abs(value) > 0.05 THEN sign(value) * (abs(value) - 0.05) ELSE 0.0::DOUBLE END")
_add("p10_rescale", lambda s, d: pixel.rescale(fx.img8(s, d), 0, 255), """
SELECT image_id, x, y, z, round((value - min(value) OVER w) * (255.0::DOUBLE / (max(value) OVER w - min(value) OVER w)), 6) + 0.0 AS value
FROM img8 WINDOW w AS (PARTITION BY image_id)""")
_add("p10_rescale_inside_mask", lambda s, d: pixel.rescale(fx.img8(s, d), 0, 1, _mask8(s, d)), """
SELECT i.image_id, i.x, i.y, i.z, round((i.value - lo) * (1.0::DOUBLE / (hi - lo)), 6) + 0.0 AS value FROM img8 i
JOIN (SELECT a.image_id, min(a.value) AS lo, max(a.value) AS hi FROM img8 a JOIN mask8 m USING (image_id, x, y, z) WHERE m.value <> 0 GROUP BY a.image_id) USING (image_id)""", fx.IMG8, fx.MASK8)
_add("p11_rotate180_in_plane", lambda s, d: pixel.rotate180_in_plane(fx.img8(s, d), headers(fx.img8(s, d))), "SELECT image_id, 7 - x AS x, 7 - y AS y, z, round(value, 6) + 0.0 AS value FROM img8")
_add("p12_extract", lambda s, d: pixel.extract(fx.img8(s, d), 2, 5, 1, 3), "SELECT image_id, x - 2 AS x, y - 1 AS y, z, round(value, 6) + 0.0 AS value FROM img8 WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3")
_add("p12_extract_header", lambda s, d: pixel.extract_header(headers(fx.img8(s, d)), 2, 5, 1, 3), "SELECT vec_id AS image_id, 4 AS width, 3 AS height, 1 AS depth, 2.0::DOUBLE AS ox, 1.0::DOUBLE AS oy, 0.0::DOUBLE AS oz, 1.0::DOUBLE AS sx, 1.0::DOUBLE AS sy, 1.0::DOUBLE AS sz FROM embeddings")
_add("p13_extract_slice", lambda s, d: pixel.extract_slice(fx.vol4(s, d), 2), "SELECT image_id, x, y, 0 AS z, round(value, 6) + 0.0 AS value FROM vol4 WHERE z = 2", fx.VOL4)
_add("p14_set_geometry", lambda s, d: pixel.set_geometry(headers(fx.vol4(s, d)), (1.0, 2.0, 3.0), (0.5, 0.5, 2.0)), "SELECT vec_id AS image_id, 4 AS width, 4 AS height, 4 AS depth, 1.0::DOUBLE AS ox, 2.0::DOUBLE AS oy, 3.0::DOUBLE AS oz, 0.5::DOUBLE AS sx, 0.5::DOUBLE AS sy, 2.0::DOUBLE AS sz FROM embeddings")
_add("p15_linear_index", lambda s, d: fx.vol4(s, d).select(*KEY, (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("i")), "SELECT image_id, x, y, z, z * 16 + y * 4 + x AS i FROM vol4", fx.VOL4)
_add("p15_contains", lambda s, d: pixel.contains(headers(_ragged(s, d)), 3, 2, 0), "SELECT image_id, max(x) >= 3 AND max(y) >= 2 AS inside FROM ragged GROUP BY image_id", fx.IMG8, RAGGED)
_add("p15_pixel_at", lambda s, d: pixel.pixel_at(fx.img8(s, d), 3, 4), "SELECT image_id, round(value, 6) + 0.0 AS value FROM img8 WHERE x = 3 AND y = 4")
_add("p16_display_byte", lambda s, d: pixel.display_byte(fx.event_raster(s, d), 200, 900), """
SELECT image_id, x, y, z, CAST(greatest(0, least(255, CASE WHEN hi = lo THEN 0 ELSE trunc((c - lo) * (255.0::DOUBLE / (hi - lo))) END)) AS INTEGER) AS byte,
       CASE WHEN value < 200 THEN 'below' WHEN value > 900 THEN 'above' ELSE 'inside' END AS class
FROM (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi FROM (SELECT *, greatest(200.0::DOUBLE, least(value, 900.0::DOUBLE)) AS c FROM raster) WINDOW w AS (PARTITION BY image_id))""", fx.EVENTS)
_add("p16_display_byte_masked", lambda s, d: pixel.display_byte(fx.img8(s, d), -0.1, 0.2, _mask8(s, d)), """
SELECT image_id, x, y, z, CAST(trunc(greatest(0, least(255, CASE WHEN hi = lo THEN 0 ELSE (c - lo) * (255.0::DOUBLE / (hi - lo)) END))) AS INTEGER) AS byte,
       CASE WHEN m = 0 THEN 'outside' WHEN value < -0.1 THEN 'below' WHEN value > 0.2 THEN 'above' ELSE 'inside' END AS class
FROM (SELECT *, min(CASE WHEN m <> 0 THEN c END) OVER w AS lo, max(CASE WHEN m <> 0 THEN c END) OVER w AS hi
      FROM (SELECT a.image_id, a.x, a.y, a.z, a.value, m.value AS m, greatest(-0.1::DOUBLE, least(a.value, 0.2::DOUBLE)) AS c FROM img8 a JOIN mask8 m USING (image_id, x, y, z))
      WINDOW w AS (PARTITION BY image_id))""", fx.IMG8, fx.MASK8)
_add("p16_display_byte_plain", lambda s, d: pixel.display_byte(_positive8(s, d), rescaled=False, multiplied=True), """
SELECT image_id, x, y, z, CAST(trunc(greatest(0, least(255, (value + min(value) OVER (PARTITION BY image_id)) * 255))) AS INTEGER) AS byte, 'inside' AS class FROM pos8""", fx.IMG8, fx.POS8)
POLYGON = ((1, 0, 1.0, 1.0, 0), (1, 1, 6.0, 1.0, 0), (1, 2, 6.0, 5.0, 0), (1, 3, 3.5, 3.0, 0), (1, 4, 1.0, 5.0, 0))
_add("p18_polygon_mask", lambda s, d: pixel.polygon_mask(headers(fx.img8(s, d)), _values(s, "poly_id int, vertex int, x double, y double, slice int", *POLYGON)), """
, e AS (SELECT * FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE, 6.0::DOUBLE, 1.0::DOUBLE), (6, 1, 6, 5), (6, 5, 3.5, 3), (3.5, 3, 1, 5), (1, 5, 1, 1)) AS t(x1, y1, x2, y2))
SELECT image_id, x, y, z, CASE WHEN coalesce((SELECT sum(CASE WHEN y2 > y1 THEN 1 ELSE -1 END) FROM e
  WHERE ((y1 <= g.y AND g.y < y2) OR (y2 <= g.y AND g.y < y1)) AND x1 + (g.y - y1) / (y2 - y1) * (x2 - x1) > g.x), 0) <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM img8 g""")
STROKES = ((1, 3, 3, 0, True), (2, 4, 3, 0, True), (3, 0, 0, 0, False))
_add("p19_brush_shading", lambda s, d: pixel.brush_shading(fx.img8(s, d), _values(s, "stroke_id int, x int, y int, z int, increase boolean", *STROKES), 4, 3.0, 1.5), """
, s AS (SELECT * FROM (VALUES (3, 3, 1), (4, 3, 1), (0, 0, -1)) AS t(sx, sy, w))
SELECT image_id, x, y, z, round(value * coalesce((SELECT exp(sum(w * ln(1 + 0.5 * exp(-((g.x - sx) * (g.x - sx) + (g.y - sy) * (g.y - sy)) / 3.0::DOUBLE)))) FROM s
  WHERE g.x - sx BETWEEN -2 AND 1 AND g.y - sy BETWEEN -2 AND 1), 1), 6) + 0.0 AS value FROM img8 g""")
SEEDS = ((1, "a", 0, 2, 2, 0, 0.1), (1, "a", 1, 5, 5, 0, 0.05), (2, "b", 0, 6, 1, 0, 0.2))
SEED_SCHEMA = "segment_id int, name string, seed_no int, x int, y int, z int, tolerance double"
_add("p20_labels_from_seeds", lambda s, d: pixel.labels_from_seeds(headers(fx.img8(s, d)), _values(s, SEED_SCHEMA, *SEEDS)), "SELECT image_id, x, y, z, CASE WHEN (x, y) IN ((2, 2), (5, 5)) THEN 1.0::DOUBLE WHEN x = 6 AND y = 1 THEN 2.0 ELSE 0.0 END AS value FROM img8")
_add("p21_mask_edge_class", lambda s, d: pixel.mask_edge_class(_mask8(s, d)), 'SELECT image_id, x, y, z, x = 0 AS "left", x = 7 AS "right", y = 0 AS top, y = 7 AS bottom, true AS front, true AS back FROM mask8 WHERE value >= 1', fx.IMG8, fx.MASK8)

# --- joins

PAIRED = "img8 a JOIN pair8 b USING (image_id, x, y, z)"
JOINED = "SELECT a.image_id, a.x, a.y, a.z, round({}, 6) + 0.0 AS value FROM " + PAIRED
for _name, _expression in {"add": "a.value + b.value", "subtract": "a.value - b.value", "multiply": "a.value * b.value", "divide": "CASE WHEN b.value > 1e-7 THEN a.value / b.value ELSE a.value END"}.items():
    _add(f"j{2 if _name == 'divide' else 1}_{_name}", lambda s, d, f=getattr(joins, _name): f(fx.img8(s, d), fx.pair8(s, d)), JOINED.format(_expression), fx.IMG8, fx.PAIR8)
_add("j3_binary_op", lambda s, d: joins.binary_op(fx.img8(s, d), fx.pair8(s, d), "subtract", 0.5, 0.1), JOINED.format("a.value - (b.value * 0.5 + 0.1)"), fx.IMG8, fx.PAIR8)
_add("j3_binary_op_constant", lambda s, d: joins.binary_op(fx.img8(s, d), None, "multiply", 1.0, 2.0), V.format("value * 2") + "img8")
MASKED = "SELECT a.image_id, a.x, a.y, a.z, round({}, 6) + 0.0 AS value FROM img8 a JOIN mask8 m USING (image_id, x, y, z)"
_add("j4_apply_mask", lambda s, d: joins.apply_mask(fx.img8(s, d), _mask8(s, d)), MASKED.format("a.value * m.value"), fx.IMG8, fx.MASK8)
_add("j5_inside_mask", lambda s, d: joins.inside_mask(fx.img8(s, d), _mask8(s, d)), MASKED.format("a.value") + " WHERE m.value <> 0", fx.IMG8, fx.MASK8)
_add("j6_add_background", lambda s, d: joins.add_background(fx.img8(s, d), fx.pair8(s, d), _mask8(s, d)), "SELECT a.image_id, a.x, a.y, a.z, round(b.value + a.value * (1 - m.value), 6) + 0.0 AS value FROM img8 a JOIN pair8 b USING (image_id, x, y, z) JOIN mask8 m USING (image_id, x, y, z)", fx.IMG8, fx.PAIR8, fx.MASK8)
_add("j7_same_size", lambda s, d: joins.same_size(headers(fx.img8(s, d)), headers(_ragged(s, d))), "SELECT image_id, max(x) = 7 AND max(y) = 7 AS same FROM ragged GROUP BY image_id", fx.IMG8, RAGGED)
STAT = "SELECT image_id, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM {} GROUP BY image_id"
for _mode, _expression in {"mean_add": "value + (r.mean - i.mean)", "mean_scale": "value * (r.mean / i.mean)", "std": "value * (r.sd / i.sd)", "range": "value * ((r.hi - r.lo) / (i.hi - i.lo))"}.items():
    _add(
        f"j8_normalize_{_mode}", lambda s, d, m=_mode: joins.normalize_statistics(_positive8(s, d), fx.positive(fx.pair8(s, d)), m),
        f"SELECT p.image_id, x, y, z, round({_expression}, 6) + 0.0 AS value FROM pos8 p JOIN ({STAT.format('pos8')}) i USING (image_id) JOIN ({STAT.format('ppair8')}) r USING (image_id)",
        fx.IMG8, fx.POS8, fx.PAIR8, "ppair8 AS (SELECT image_id, x, y, z, value - min(value) OVER (PARTITION BY image_id) + 1 AS value FROM pair8)",
    )
_add("j9_grid_sweep", lambda s, d: joins.grid_sweep(fx.img8(s, d).select("image_id").distinct(), sweeps.parameter_grid(s, [0.1, 0.2, 0.4], [1.0, 2.0])), """
SELECT e.vec_id AS image_id, CAST(row_number() OVER (PARTITION BY e.vec_id ORDER BY a0, a1) - 1 AS INTEGER) AS set_no, a0 AS alpha0, a1 AS alpha1, 1.0::DOUBLE AS weight,
       concat(e.vec_id, '-', row_number() OVER (PARTITION BY e.vec_id ORDER BY a0, a1) - 1) AS run_id
FROM embeddings e CROSS JOIN (VALUES (0.1::DOUBLE), (0.2), (0.4)) AS p(a0) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0)) AS q(a1)""")

# --- aggregates

_INFO = """CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(z) + 1 AS INTEGER) AS depth, count(*) AS voxel_count,
round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(var_samp(value), 6) + 0.0 AS variance, round(stddev_samp(value) / avg(value), 6) + 0.0 AS cv,
round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(sum(abs(value)), 6) + 0.0 AS sum_abs, round(sum(value * value), 6) + 0.0 AS sum_sq"""
_add("a1_image_information", lambda s, d: stats.image_information(_positive8(s, d)), f"SELECT image_id, {_INFO} FROM pos8 GROUP BY image_id", fx.IMG8, fx.POS8)
_add("a2_min_max", lambda s, d: stats.min_max(fx.sales_volume(s, d)), "SELECT image_id, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max FROM sales GROUP BY image_id", fx.SALES)
_add("a3_min_max_inside_mask", lambda s, d: stats.min_max(fx.img8(s, d), _mask8(s, d)), "SELECT a.image_id, round(min(a.value), 6) + 0.0 AS min, round(max(a.value), 6) + 0.0 AS max FROM img8 a JOIN mask8 m USING (image_id, x, y, z) WHERE m.value <> 0 GROUP BY a.image_id", fx.IMG8, fx.MASK8)
TV = "tvs AS (SELECT image_id, abs(coalesce(lead(value) OVER (PARTITION BY image_id, y, z ORDER BY x) - value, 0)) + abs(coalesce(lead(value) OVER (PARTITION BY image_id, x, z ORDER BY y) - value, 0)) + abs(coalesce(lead(value) OVER (PARTITION BY image_id, x, y ORDER BY z) - value, 0)) AS s FROM {})"
_add("a4_total_variation", lambda s, d: stats.total_variation(fx.vol4(s, d)), "SELECT image_id, round(sum(s), 6) + 0.0 AS tv, round(sum(s) / count(*), 6) + 0.0 AS mean_tv FROM tvs GROUP BY image_id", fx.VOL4, TV.format("vol4"))
_add("a4_total_variation_sales", lambda s, d: stats.total_variation(fx.sales_volume(s, d)).select("image_id", F.round("mean_tv", 3).alias("mean_tv")), "SELECT image_id, round(round(sum(s) / count(*), 3), 6) + 0.0 AS mean_tv FROM tvs GROUP BY image_id", fx.SALES, TV.format("sales"))
_add("a5_mean_sd", lambda s, d: stats.mean_sd(fx.img8(s, d)), I8.format("round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd"))
_add("a6_normalized_cross_correlation", lambda s, d: stats.normalized_cross_correlation(fx.img8(s, d), fx.pair8(s, d)), f"SELECT a.image_id, round(covar_pop(a.value, b.value) / (stddev_samp(a.value) * stddev_samp(b.value)), 6) + 0.0 AS ncc FROM {PAIRED} GROUP BY a.image_id", fx.IMG8, fx.PAIR8)
_add("a7_sum_abs_change", lambda s, d: stats.sum_abs_change(fx.img8(s, d), fx.pair8(s, d)), f"SELECT a.image_id, round(sum(abs(a.value - b.value)), 6) + 0.0 AS change FROM {PAIRED} GROUP BY a.image_id", fx.IMG8, fx.PAIR8)
HIST = """bins AS (SELECT DISTINCT image_id, CAST(b AS INTEGER) AS bin FROM img8 CROSS JOIN range(0, 16) AS r(b)),
hits AS (SELECT image_id, CAST(trunc((value + 0.4) / ((0.4 + 0.4)::DOUBLE / 16)) AS INTEGER) AS bin, count(*) AS n FROM img8 GROUP BY ALL),
hist AS (SELECT image_id, bin, -0.4::DOUBLE + bin * 0.05::DOUBLE AS intensity, coalesce(n, 0) / greatest(1, sum(coalesce(n, 0)) OVER (PARTITION BY image_id)) AS probability FROM bins LEFT JOIN hits USING (image_id, bin))"""
_add("a8_histogram", lambda s, d: stats.histogram(fx.img8(s, d), 16, -0.4, 0.4), "SELECT image_id, bin, round(intensity, 6) + 0.0 AS intensity, round(probability, 6) + 0.0 AS probability FROM hist", fx.IMG8, HIST)
KDE = """kbins AS (SELECT DISTINCT image_id, CAST(b AS INTEGER) AS bin, -0.4 + b * (0.8::DOUBLE / 32) AS g FROM img8 CROSS JOIN range(0, 32) AS r(b)),
kde AS (SELECT k.image_id, k.bin, k.g, sum(CASE WHEN abs((k.g - i.value) / 0.1) < 1 THEN {} ELSE 0 END) AS s FROM kbins k JOIN img8 i USING (image_id) GROUP BY ALL)"""
for _kernel, _expression in {"uniform": "1.0::DOUBLE", "gaussian": "exp(-power((k.g - i.value) / 0.1, 2) / 2) / sqrt(2 * pi())", "cosine": "pi() / 4 * cos(pi() / 2 * (k.g - i.value) / 0.1)", "epanechnikov": "0.75 * (1 - power((k.g - i.value) / 0.1, 2))"}.items():
    _add(f"a9_kde_{_kernel}", lambda s, d, k=_kernel: stats.kde(fx.img8(s, d), 32, 0.1, k, -0.4, 0.4), "SELECT image_id, bin, round(g, 6) + 0.0 AS intensity, round(s / CASE WHEN sum(s) OVER w = 0 THEN 1 ELSE sum(s) OVER w END, 6) + 0.0 AS probability FROM kde WINDOW w AS (PARTITION BY image_id)", fx.IMG8, KDE.format(_expression))
_add("a10_entropy", lambda s, d: stats.entropy(stats.histogram(fx.img8(s, d), 16, -0.4, 0.4)), "SELECT image_id, round(sum(CASE WHEN probability >= 1e-5 THEN -probability * log2(probability) ELSE 0 END), 6) + 0.0 AS entropy FROM hist GROUP BY image_id", fx.IMG8, HIST)


def _entropy_of(source: str, prefix: str = "", bins: int = 8, key: str = "image_id") -> str:
    """`ent`: the entropy of the Epanechnikov density of each image of source; bins: the square root of its voxels."""
    return f"""{prefix}span AS (SELECT {key}, min(value) AS lo, (max(value) - min(value)) / ceil(sqrt(count(*))) AS w FROM {source} GROUP BY {key}),
{prefix}dens AS (SELECT {key}, b.b, sum(CASE WHEN abs((lo + b.b * w - value) / w) < 1 THEN 0.75 * (1 - power((lo + b.b * w - value) / w, 2)) ELSE 0 END) AS k
         FROM {prefix}span JOIN {source} USING ({key}) CROSS JOIN range(0, {bins}) AS b(b) GROUP BY ALL),
{prefix}ent AS (SELECT {key}, sum(CASE WHEN p >= 1e-5 THEN -p * log2(p) ELSE 0 END) AS entropy FROM (SELECT {key}, k / sum(k) OVER (PARTITION BY {key}) AS p FROM {prefix}dens) GROUP BY {key})"""


def _metrics_of(source: str, prefix: str = "", bins: int = 8, key: str = "image_id") -> str:
    """`metrics`: (key, mean_tv, entropy, cv) of each image of source."""
    return f"""{prefix}{TV.format(source).replace("image_id", key)},
{_entropy_of(source, prefix, bins, key)},
{prefix}metrics AS (SELECT * FROM (SELECT {key}, avg(s) AS mean_tv FROM {prefix}tvs GROUP BY {key}) JOIN {prefix}ent USING ({key})
  JOIN (SELECT {key}, stddev_samp(value) / avg(value) AS cv FROM {source} GROUP BY {key}) USING ({key}))"""


ENTROPY = _entropy_of("img8")
_add("a10_kde_entropy", lambda s, d: stats.kde_entropy(fx.img8(s, d)), "SELECT image_id, round(entropy, 6) + 0.0 AS entropy FROM ent", fx.IMG8, ENTROPY)
_add("a11_auto_window_bandwidth", lambda s, d: stats.auto_window_bandwidth(fx.img8(s, d)), I8.format("round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round((max(value) - min(value)) * 0.03, 6) + 0.0 AS bandwidth"))
_add("a12_dot", lambda s, d: stats.dot(fx.img8(s, d), fx.pair8(s, d)), f"SELECT a.image_id, round(sum(a.value * b.value), 6) + 0.0 AS dot FROM {PAIRED} GROUP BY a.image_id", fx.IMG8, fx.PAIR8)
_add("a13_run_metrics", lambda s, d: stats.image_metrics(fx.img8(s, d)).select("image_id", "mean", "mean_tv", "entropy"), """
SELECT i.image_id, round(i.mean, 6) + 0.0 AS mean, round(t.mean_tv, 6) + 0.0 AS mean_tv, round(entropy, 6) + 0.0 AS entropy
FROM (SELECT image_id, avg(value) AS mean FROM img8 GROUP BY image_id) i JOIN (SELECT image_id, avg(s) AS mean_tv FROM tvs GROUP BY image_id) t USING (image_id) JOIN ent USING (image_id)""", fx.IMG8, TV.format("img8"), ENTROPY)
_CHANGES = ", ".join(f"round((a.{c} - b.{c}) / a.{c} * 100, 6) + 0.0 AS {c}" for c in ("entropy", "cv", "mean_tv"))
_TWO = (fx.IMG8, fx.POS8, fx.PAIR8, "ppair8 AS MATERIALIZED (SELECT image_id, x, y, z, value - min(value) OVER (PARTITION BY image_id) + 1 AS value FROM pair8)", _metrics_of("pos8", "a"), _metrics_of("ppair8", "b"))
_add("a14_compare_metrics", lambda s, d: stats.compare_metrics(stats.image_metrics(_positive8(s, d)), stats.image_metrics(fx.positive(fx.pair8(s, d)))), f"SELECT image_id, {_CHANGES} FROM ametrics a JOIN bmetrics b USING (image_id)", *_TWO)
_add("a13_run_metrics_both", lambda s, d: stats.run_metrics(_positive8(s, d), fx.positive(fx.pair8(s, d))), """
SELECT image_id, round(a.cv, 6) + 0.0 AS denoised_cv, round(a.mean_tv, 6) + 0.0 AS denoised_tv, round(b.cv, 6) + 0.0 AS deshaded_cv, round(b.mean_tv, 6) + 0.0 AS deshaded_tv, round(b.entropy, 6) + 0.0 AS deshaded_entropy
FROM ametrics a JOIN bmetrics b USING (image_id)""", *_TWO)
# Constant images and images of mean 0: no ratio, no correlation.
_FLAT = "flat AS MATERIALIZED (SELECT image_id, x, y, z, CASE WHEN image_id % 2 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM img8)"
_flat = lambda s, d: fx.img8(s, d).withColumn("value", F.when(F.col("image_id") % 2 == 0, 0.0).otherwise(F.col("value")))
_add("a1_image_information_constant", lambda s, d: stats.image_information(_flat(s, d)).select("image_id", "mean", "sd", "cv"), "SELECT image_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) END, 6) + 0.0 AS cv FROM flat GROUP BY image_id", fx.IMG8, _FLAT)
_add("a6_correlation_constant", lambda s, d: stats.normalized_cross_correlation(fx.img8(s, d), _flat(s, d)), "SELECT a.image_id, round(CASE WHEN stddev_samp(b.value) > 0 THEN covar_pop(a.value, b.value) / (stddev_samp(a.value) * stddev_samp(b.value)) END, 6) + 0.0 AS ncc FROM img8 a JOIN flat b USING (image_id, x, y, z) GROUP BY a.image_id", fx.IMG8, _FLAT)
_add("j8_normalize_constant", lambda s, d: joins.normalize_statistics(_flat(s, d), fx.img8(s, d), "std"), f"SELECT p.image_id, x, y, z, round(CASE WHEN i.sd > 0 THEN value * (r.sd / i.sd) END, 6) + 0.0 AS value FROM flat p JOIN ({STAT.format('flat')}) i USING (image_id) JOIN ({STAT.format('img8')}) r USING (image_id)", fx.IMG8, _FLAT)
# --- windows

for _axis, _rest in {"x": "y, z", "y": "x, z", "z": "x, y"}.items():
    _add(f"w1_forward_difference_{_axis}", lambda s, d, a=_axis: windows.forward_difference(fx.vol4(s, d), a), V.format(f"coalesce(lead(value) OVER (PARTITION BY image_id, {_rest} ORDER BY {_axis}) - value, 0)") + "vol4", fx.VOL4)
    _add(f"w2_backward_difference_{_axis}", lambda s, d, a=_axis: windows.backward_difference(fx.vol4(s, d), a), V.format(f"coalesce(lag(value) OVER (PARTITION BY image_id, {_rest} ORDER BY {_axis}), 0) - value") + "vol4", fx.VOL4)
GRAD = "grad AS (SELECT image_id, x, y, z, coalesce(lead(value) OVER (PARTITION BY image_id, y, z ORDER BY x) - value, 0) AS vx, coalesce(lead(value) OVER (PARTITION BY image_id, x, z ORDER BY y) - value, 0) AS vy, coalesce(lead(value) OVER (PARTITION BY image_id, x, y ORDER BY z) - value, 0) AS vz FROM vol4)"
DIV = "coalesce(lag(vx) OVER (PARTITION BY image_id, y, z ORDER BY x), 0) - vx + coalesce(lag(vy) OVER (PARTITION BY image_id, x, z ORDER BY y), 0) - vy + coalesce(lag(vz) OVER (PARTITION BY image_id, x, y ORDER BY z), 0) - vz"
_add("w3_divergence", lambda s, d: windows.divergence(windows.gradient(fx.vol4(s, d))), V.format(DIV) + "grad", fx.VOL4, GRAD)
_add("w4_div_grad", lambda s, d: windows.div_grad(fx.vol4(s, d)), V.format(DIV) + "grad", fx.VOL4, GRAD)
_add("w5_integrate_gradients", lambda s, d: windows.integrate_gradients(windows.gradient(fx.vol4(s, d))), """
SELECT g.image_id, g.x, g.y, g.z, round(
  (SELECT coalesce(sum(vx), 0) FROM grad a WHERE a.image_id = g.image_id AND a.y = 0 AND a.z = 0 AND a.x BETWEEN 1 AND g.x)
  + (SELECT coalesce(sum(vy), 0) FROM grad a WHERE a.image_id = g.image_id AND a.x = g.x AND a.z = 0 AND a.y BETWEEN 1 AND g.y)
  + (SELECT coalesce(sum(vz), 0) FROM grad a WHERE a.image_id = g.image_id AND a.x = g.x AND a.y = g.y AND a.z BETWEEN 1 AND g.z), 6) + 0.0 AS value FROM grad g""", fx.VOL4, GRAD)
LINES = ((1, 0, 0, 0, 7, 0, 0), (2, 1, 6, 0, 1, 2, 0), (3, 0, 0, 0, 7, 7, 0), (4, 2, 2, 0, 2, 2, 0), (5, 4, 4, 0, 9, 4, 0))
_add("w6_line_profile", lambda s, d: windows.line_profile(fx.img8(s, d), _values(s, "line_id int, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int", *LINES)), """
, p AS (SELECT 1 AS line_id, CAST(i AS INTEGER) AS pos, CAST(i AS INTEGER) AS x, 0 AS y FROM range(0, 8) AS r(i)
  UNION ALL SELECT 2, CAST(i AS INTEGER), 1, CAST(6 - i AS INTEGER) FROM range(0, 5) AS r(i)
  UNION ALL SELECT 3, CAST(i AS INTEGER), CAST(i AS INTEGER), CAST(i AS INTEGER) FROM range(0, 8) AS r(i)
  UNION ALL SELECT 4, 0, 2, 2)
SELECT image_id, line_id, pos, round(pos * CASE WHEN line_id = 3 THEN sqrt(2) ELSE 1 END, 6) + 0.0 AS distance, round(value, 6) + 0.0 AS value FROM img8 JOIN p USING (x, y)""")
_HISTORY = "SELECT image_id AS run, 'm' AS metric, x AS t, value FROM img8 WHERE y = 0"
_add("w7_metric_total_variation", lambda s, d: windows.metric_total_variation(fx.img8(s, d).where("y = 0").select(F.col("image_id").alias("run"), F.lit("m").alias("metric"), F.col("x").alias("t"), "value")), f"""
SELECT run, metric, round(sum(step), 6) + 0.0 AS tv FROM (SELECT run, metric, t, abs(lead(value) OVER (PARTITION BY run ORDER BY t) - value) AS step FROM ({_HISTORY})) WHERE t < 6 GROUP BY run, metric""")

# --- choices


def _runs(s: SparkSession, d: str) -> DataFrame:
    """img8 as a run table: an image is a run, two voxels are its parameters and one its metric."""
    at = lambda x: F.max(F.when((F.col("x") == x) & (F.col("y") == 0), F.col("value")))
    return fx.img8(s, d).groupBy(F.col("image_id").alias("id")).agg(at(0).alias("alpha0"), at(1).alias("alpha1"), at(2).alias("metric"))


RUNS = "runs AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS alpha0, embedding[2]::DOUBLE AS alpha1, embedding[3]::DOUBLE AS metric FROM embeddings)"
_add("k1_select_minimum", lambda s, d: stats.select_minimum(_runs(s, d), "metric", "alpha0", "alpha1"), "SELECT id, round(metric, 6) + 0.0 AS metric, round(alpha0, 6) + 0.0 AS alpha0, round(alpha1, 6) + 0.0 AS alpha1 FROM runs ORDER BY metric, id LIMIT 1", RUNS)
_add("k2_next_search_space", lambda s, d: stats.next_search_space(_runs(s, d), "metric", "alpha0", "alpha1"), """
SELECT round(m.alpha0 - s0, 6) + 0.0 AS alpha0_min, round(m.alpha0 + s0, 6) + 0.0 AS alpha0_max, round(m.alpha1 - s1, 6) + 0.0 AS alpha1_min, round(m.alpha1 + s1, 6) + 0.0 AS alpha1_max
FROM (SELECT * FROM runs ORDER BY metric, id LIMIT 1) m CROSS JOIN (SELECT (max(alpha0) - min(alpha0)) / count(DISTINCT alpha0) AS s0, (max(alpha1) - min(alpha1)) / count(DISTINCT alpha1) AS s1 FROM runs)""", RUNS)
_add("k3_select_step_sizes", lambda s, d: stats.select_step_sizes(fx.img8(s, d).where("y = 1").select(F.col("image_id").alias("run"), F.col("x").alias("i"), F.col("value").alias("metric"))), "SELECT image_id AS run, min(x) - 1 AS interval FROM (SELECT image_id, x, value < lag(value) OVER (PARTITION BY image_id ORDER BY x) AS drops FROM img8 WHERE y = 1) WHERE drops GROUP BY image_id")
_add("s7_update_metrics", lambda s, d: files.update_metrics(_runs(s, d), _runs(s, d).where("alpha0 > 0").select("id", (F.col("alpha1") * 2).alias("metric")), ["metric"]), "SELECT id, round(alpha0, 6) + 0.0 AS alpha0, round(alpha1, 6) + 0.0 AS alpha1, round(CASE WHEN alpha0 > 0 THEN alpha1 * 2 ELSE metric END, 6) + 0.0 AS metric FROM runs", RUNS)

# --- stencils

NEAR = "SELECT a.image_id, a.x, a.y, a.z, round({}, 6) + 0.0 AS value FROM {} a JOIN {} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} AND abs(a.z - b.z) <= {r} GROUP BY a.image_id, a.x, a.y, a.z"
KERNEL = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_K9 = "list_extract([" + ", ".join(map(str, KERNEL)) + "], CAST(3 * (b.y - a.y + 1) + b.x - a.x + 2 AS INTEGER))"
_K27 = "(0.01::DOUBLE * (9 * (b.z - a.z + 1) + 3 * (b.y - a.y + 1) + b.x - a.x + 2))"
_add("n1_convolve3x3", lambda s, d: stencils.convolve(fx.img8(s, d), stencils.taps3x3(KERNEL)), NEAR.format(f"sum(b.value * {_K9})", "img8", "img8", r=1))
_add("n2_convolve3x3x3", lambda s, d: stencils.convolve(fx.vol4(s, d), stencils.taps3x3x3([0.01 * (i + 1) for i in range(27)])), NEAR.format(f"sum(b.value * {_K27})", "vol4", "vol4", r=1), fx.VOL4)
_CENTRE = "(a.x = b.x AND a.y = b.y AND a.z = b.z)"
_add("n3_convolve_dynamic_centre", lambda s, d: stencils.convolve(fx.img8(s, d), stencils.taps3x3(KERNEL), dynamic_centre=True), NEAR.format(f"sum(CASE WHEN {_CENTRE} THEN 0 ELSE (b.value - a.value) * {_K9} END)", "img8", "img8", r=1))
_FACE = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"
_add("n4_laplace_preset", lambda s, d: stencils.convolve(fx.vol4(s, d), stencils.preset("laplace", True), dynamic_centre=True), NEAR.format(f"sum(CASE WHEN {_FACE} THEN a.value - b.value ELSE 0 END)", "vol4", "vol4", r=1), fx.VOL4)
_add("n4_mean_preset", lambda s, d: stencils.convolve(fx.img8(s, d), stencils.preset("mean")), NEAR.format("sum(b.value)", "img8", "img8", r=1))
_add("n5_binary_dilate", lambda s, d: stencils.binary_dilate(_mask8(s, d)), NEAR.format(f"max(CASE WHEN ({_CENTRE} OR {_FACE}) AND b.value > 0.5 THEN 1.0::DOUBLE ELSE 0 END)", "mask8", "mask8", r=1), fx.IMG8, fx.MASK8)
_add("n6_neighbours", lambda s, d: stencils.neighbours(fx.vol4(s, d), headers(fx.vol4(s, d)), in_slice=False), """
SELECT image_id, x, y, z, CAST(x + a.d AS INTEGER) AS nx, CAST(y + b.d AS INTEGER) AS ny, CAST(z + c.d AS INTEGER) AS nz
FROM vol4 CROSS JOIN range(-1, 2) AS a(d) CROSS JOIN range(-1, 2) AS b(d) CROSS JOIN range(-1, 2) AS c(d)
WHERE x + a.d BETWEEN 0 AND 3 AND y + b.d BETWEEN 0 AND 3 AND z + c.d BETWEEN 0 AND 3""", fx.VOL4)
_R2 = "(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))"
_TOTAL = "(SELECT sum(exp(-(power(i.i, 2) + power(j.i, 2) + power(k.i, 2)) / 2.0)) FROM range(-1, 2) AS i(i), range(-1, 2) AS j(i), range(-1, 2) AS k(i))"
_add("n7_gaussian_kernel", lambda s, d: fx.img8(s, d).where("x = 0 and y = 0").select("image_id", F.inline(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(w).alias("weight")) for a, b, c, w in stencils.gaussian_kernel(3, 2.0))))), f"SELECT e.vec_id AS image_id, CAST(i.i AS INTEGER) AS dx, CAST(j.i AS INTEGER) AS dy, CAST(k.i AS INTEGER) AS dz, round(exp(-(power(i.i, 2) + power(j.i, 2) + power(k.i, 2)) / 2.0) / {_TOTAL}, 6) + 0.0 AS weight FROM embeddings e, range(-1, 2) AS i(i), range(-1, 2) AS j(i), range(-1, 2) AS k(i)")
_add("n8_non_local_gradient", lambda s, d: stencils.non_local_gradient(fx.vol4(s, d), 3, 2.0), NEAR.format(f"sum(abs(a.value - b.value) * exp(-{_R2} / 2.0)) / {_TOTAL}", "vol4", "vol4", r=1), fx.VOL4)
_add("n8_non_local_gradient_wide", lambda s, d: stencils.non_local_gradient(fx.vol4(s, d), 3, 2.0, wide=True), NEAR.format(f"sum(abs(a.value - b.value) * exp(-{_R2} / 2.0)) / {_TOTAL}", "vol4", "vol4", r=1), fx.VOL4)
_BIL = f"exp(-{_R2} / 4.0) * exp(-power(a.value - b.value, 2) / 0.05)"
for _suffix, _wide in {"": False, "_wide": True}.items():
    _add(f"n9_bilateral{_suffix}", lambda s, d, w=_wide: stencils.bilateral(fx.img8(s, d), 5, 4.0, 0.05, wide=w), NEAR.format(f"sum(b.value * {_BIL}) / sum({_BIL})", "img8", "img8", r=2))
_WEIGHTS = stencils.gaussian_weights(1.0, 32)
_RADIUS = len(_WEIGHTS) // 2
_LIST = "[" + ", ".join(f"{w!r}::DOUBLE" for w in _WEIGHTS) + "]"
_BLUR = f"""bx AS (SELECT p.image_id, x.x, p.y, p.z, sum(p.value * list_extract({_LIST}, CAST(o.o + {_RADIUS + 1} AS INTEGER))) AS value FROM pos8 p JOIN range(0, 8) AS x(x) ON true JOIN range(-{_RADIUS}, {_RADIUS + 1}) AS o(o) ON greatest(0, least(7, x.x + o.o)) = p.x GROUP BY ALL),
blur AS (SELECT p.image_id, CAST(p.x AS INTEGER) AS x, CAST(y.y AS INTEGER) AS y, p.z, sum(p.value * list_extract({_LIST}, CAST(o.o + {_RADIUS + 1} AS INTEGER))) AS value FROM bx p JOIN range(0, 8) AS y(y) ON true JOIN range(-{_RADIUS}, {_RADIUS + 1}) AS o(o) ON greatest(0, least(7, y.y + o.o)) = p.y GROUP BY ALL)"""
_add("n10_gaussian_blur", lambda s, d: stencils.gaussian_blur(_positive8(s, d), 1.0), V.format("value") + "blur", fx.IMG8, fx.POS8, _BLUR)
_add("n11_unsharp_mask", lambda s, d: stencils.unsharp_mask(_positive8(s, d), 32, 1.0, 0.7), "SELECT p.image_id, p.x, p.y, p.z, round(p.value + 0.7 * (p.value - b.value), 6) + 0.0 AS value FROM pos8 p JOIN blur b USING (image_id, x, y, z)", fx.IMG8, fx.POS8, _BLUR)
_add("n12_multiscale_retinex", lambda s, d: stencils.multiscale_retinex(_positive8(s, d), [(1.0, 2.0), (1.0, 1.0)]), "SELECT p.image_id, p.x, p.y, p.z, round(ln(p.value + 1) - ln(b.value + 1), 6) + 0.0 AS value FROM pos8 p JOIN blur b USING (image_id, x, y, z)", fx.IMG8, fx.POS8, _BLUR)
_add("n13_laplace", lambda s, d: windows.laplace(fx.img8(s, d)), NEAR.format(f"sum(CASE WHEN {_FACE} THEN a.value - b.value ELSE 0 END)", "img8", "img8", r=1))

# --- transforms

_DCT = "dct AS (SELECT image_id, CAST(u.k AS INTEGER) AS x, CAST(w.k AS INTEGER) AS y, 0 AS z, 8 * sum(value * cos(pi() * (x + 0.5) * u.k / 8) * cos(pi() * (y + 0.5) * w.k / 8)) AS value FROM img8 CROSS JOIN range(0, 8) AS u(k) CROSS JOIN range(0, 8) AS w(k) GROUP BY image_id, u.k, w.k)"
_POIS = "pois AS (SELECT image_id, x, y, z, CASE WHEN x = 0 AND y = 0 THEN 0 ELSE value / (4 - 2 * cos(pi() * x / 8) - 2 * cos(pi() * y / 8)) END AS value FROM dct)"
_IDCT = "SELECT image_id, CAST(u.k AS INTEGER) AS x, CAST(w.k AS INTEGER) AS y, 0 AS z, round(sum(value * CASE WHEN x = 0 THEN 1 ELSE 2 * cos(pi() * (u.k + 0.5) * x / 8) END * CASE WHEN y = 0 THEN 1 ELSE 2 * cos(pi() * (w.k + 0.5) * y / 8) END) / 512, 6) + 0.0 AS value FROM {} CROSS JOIN range(0, 8) AS u(k) CROSS JOIN range(0, 8) AS w(k) GROUP BY image_id, u.k, w.k"
_MEAN = V.format("value - avg(value) OVER (PARTITION BY image_id)")
_add("x1_dct", lambda s, d: transforms.dct(fx.img8(s, d)), V.format("value") + "dct", fx.IMG8, _DCT)
_add("x2_idct", lambda s, d: transforms.idct(fx.img8(s, d)), _IDCT.format("img8"))
_add("x2_idct_of_dct", lambda s, d: transforms.idct(transforms.dct(fx.vol4(s, d))), V.format("value") + "vol4", fx.VOL4)
_add("x3_poisson_cosine", lambda s, d: transforms.poisson_cosine(transforms.dct(fx.img8(s, d))), V.format("value") + "pois", fx.IMG8, _DCT, _POIS)
_add("x4_solve_poisson", lambda s, d: transforms.solve_poisson(fx.img8(s, d)), _IDCT.format("pois"), fx.IMG8, _DCT, _POIS)
_add("x5_remove_zero_frequency", lambda s, d: transforms.remove_zero_frequency(fx.vol4(s, d)), _MEAN + "vol4", fx.VOL4)
_add("x6_integrate_gradients_poisson", lambda s, d: transforms.integrate_gradients_poisson(windows.gradient(fx.img8(s, d))), _MEAN + "img8")
_add("x7_resize_nearest", lambda s, d: transforms.resize(fx.img8(s, d), 0.5, "nearest"), "SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, z, round(value, 6) + 0.0 AS value FROM img8 WHERE x % 2 = 0 AND y % 2 = 0")
_LIN = "{0}.i AS {0}, floor({0}.i * 0.5) AS {0}0, least(7, floor({0}.i * 0.5) + 1) AS {0}1, {0}.i * 0.5 - floor({0}.i * 0.5) AS t{0}"
_add("x7_resize_linear", lambda s, d: transforms.resize(fx.img8(s, d), 2.0, "linear", pad=0), f"""
SELECT a.image_id, CAST(g.x AS INTEGER) AS x, CAST(g.y AS INTEGER) AS y, 0 AS z, round(sum(a.value * ((CASE WHEN a.x = x0 THEN 1 - tx ELSE 0 END) + (CASE WHEN a.x = x1 THEN tx ELSE 0 END)) * ((CASE WHEN a.y = y0 THEN 1 - ty ELSE 0 END) + (CASE WHEN a.y = y1 THEN ty ELSE 0 END))), 6) + 0.0 AS value
FROM (SELECT {_LIN.format('x')}, {_LIN.format('y')} FROM range(0, 16) AS x(i) CROSS JOIN range(0, 16) AS y(i)) g JOIN img8 a ON a.x IN (x0, x1) AND a.y IN (y0, y1) GROUP BY a.image_id, g.x, g.y""")
_SINC = "CASE WHEN abs(d) < 1e-12 THEN 1 WHEN abs(d) >= 4 THEN 0 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) END"
_CUBIC = "CASE WHEN abs(d) <= 1 THEN 1.25 * abs(d) ** 3 - 2.25 * d * d + 1 WHEN abs(d) < 2 THEN -0.75 * abs(d) ** 3 + 3.75 * d * d - 6 * abs(d) + 3 ELSE 0 END"
_FLATXY = "SELECT image_id, x, y, 0 AS z, round(value, 6) + 0.0 AS value FROM out"
_add("x7_resize_sinc", lambda s, d: transforms.resize(fx.img8(s, d), 1.5, "sinc", pad=0), _FLATXY, fx.IMG8, ss.resampled("img8", "out", 8, 8, _SINC, -3, 4, 12, 12))
_add("x7_resize_bspline3", lambda s, d: transforms.resize(fx.img8(s, d), 1.0, "bspline3"), V.format("value") + "img8")
_add("x8_resize_auto", lambda s, d: transforms.resize_auto(fx.img8(s, d), 5, 7, 1), _FLATXY, fx.IMG8, ss.resampled("img8", "out", 8, 8, _CUBIC, -1, 2, 5, 7, "(o + 0.5) * n / m::DOUBLE - 0.5"))
# Enlarged: new voxel o covers [o, o + 1) * 8 / m; what lies past the next old voxel's start is its share.
_AREA = "SELECT o, floor(o * 8 / {0}.0::DOUBLE) AS i0, least(7, floor(o * 8 / {0}.0::DOUBLE) + 1) AS i1, greatest(0, (o + 1) - (floor(o * 8 / {0}.0::DOUBLE) + 1) * {0} / 8.0::DOUBLE) AS s FROM range(0, {0}) AS r(o)"
_add("x8_resize_auto_enlarged", lambda s, d: transforms.resize_auto(fx.img8(s, d), 12, 10, 1), f"""
SELECT v.image_id, CAST(a.o AS INTEGER) AS x, CAST(b.o AS INTEGER) AS y, 0 AS z,
       round(sum(v.value * (CASE WHEN v.x = a.i0 THEN 1 - (a.s - floor(a.s)) ELSE 0 END + CASE WHEN v.x = a.i1 THEN a.s - floor(a.s) ELSE 0 END)
                         * (CASE WHEN v.y = b.i0 THEN 1 - (b.s - floor(b.s)) ELSE 0 END + CASE WHEN v.y = b.i1 THEN b.s - floor(b.s) ELSE 0 END)), 6) + 0.0 AS value
FROM img8 v JOIN ({_AREA.format(12)}) a ON v.x IN (a.i0, a.i1) JOIN ({_AREA.format(10)}) b ON v.y IN (b.i0, b.i1) GROUP BY v.image_id, a.o, b.o""")
_add("x9_shrink", lambda s, d: transforms.shrink(fx.img8(s, d), 3, 2), "SELECT image_id, CAST((x - 1) // 3 AS INTEGER) AS x, CAST((y - 1) // 2 AS INTEGER) AS y, z, round(value, 6) + 0.0 AS value FROM img8 WHERE x IN (1, 4) AND y IN (1, 3, 5, 7)")

# --- solvers

_LAST = "SELECT image_id, x, y, z, round(u, 6) + 0.0 AS value FROM st WHERE it = {}"
_WEIGHTED = "weighted AS MATERIALIZED (SELECT a.image_id, a.x, a.y, a.z, a.value, m.value * 8 + 1 AS lam FROM img8 a JOIN mask8 m USING (image_id, x, y, z))"
_MASKED8 = "masked AS MATERIALIZED (SELECT a.image_id, a.x, a.y, a.z, a.value, m.value AS m FROM img8 a JOIN mask8 m USING (image_id, x, y, z))"
_add("i1_tv_l2", lambda s, d: solvers.tv_l2(fx.img8(s, d), 8.0, 1.0, 50), _LAST.format(50), fx.IMG8, ss.variation("img8", 2, 1, (1.0,), 8.0, 50, "l2"))
_add("i2_tv_l1", lambda s, d: solvers.tv_l1(fx.img8(s, d), 1.0, 1.0, 50), _LAST.format(50), fx.IMG8, ss.variation("img8", 2, 1, (1.0,), 1.0, 50))
_add("i3_tgv2_l1", lambda s, d: solvers.tgv2_l1(fx.vol4(s, d), 1.0, 2.0, 1.0, 50), _LAST.format(50), fx.VOL4, ss.variation("vol4", 3, 2, (1.0, 2.0), 1.0, 50))
_add("i4_tgv2_l2", lambda s, d: solvers.tgv2_l2(fx.img8(s, d), 8.0, 2.0, 1.0, 50), _LAST.format(50), fx.IMG8, ss.variation("img8", 2, 2, (1.0, 2.0), 8.0, 50, "l2"))
_add("i5_tgv2_lambda_map", lambda s, d: solvers.tgv2_lambda_map(fx.img8(s, d), _mask8(s, d), 8.0, 1.0, 2.0, 1.0, 50), _LAST.format(50), fx.IMG8, fx.MASK8, _WEIGHTED, ss.variation("weighted", 2, 2, (1.0, 2.0), "lam", 50, "l2"))
_add("i6_tgv3_l1", lambda s, d: solvers.tgv3_l1(fx.img8(s, d), 1.0, 2.0, 1.0, 3.0, 50), _LAST.format(50), fx.IMG8, ss.variation("img8", 2, 3, (1.0, 2.0, 3.0), 1.0, 50, first="forward"))
_add("i7_tgvk_l1", lambda s, d: solvers.tgvk_l1(fx.img8(s, d), 1.0, 4, solvers.default_alpha(4), 50), _LAST.format(50), fx.IMG8, ss.variation("img8", 2, 4, solvers.default_alpha(4), 1.0, 50))
_PARTS = "SELECT s.image_id, s.x, s.y, s.z, round(s.u, 6) + 0.0 AS denoised, round(h.value{m}, 6) + 0.0 AS shading, round({d}, 6) + 0.0 AS deshaded{v} FROM {s} JOIN shading h USING (image_id, x, y){j} WHERE s.it = {n}"
_MASKS = " JOIN mask8 k USING (image_id, x, y, z)"
_DIV_V = f", round(f.value, 6) + 0.0 AS div_v"
_add("i8_deshade_tgv2", lambda s, d: solvers.deshade(fx.event_raster(s, d), Variation(2, (1.0, 2.0), 0.5), 100, div_v=True),
     _PARTS.format(m="", d="s.u - h.value", v=_DIV_V, s="st s", j=" JOIN shading_f f USING (image_id, x, y)", n=100), fx.EVENTS, ss.variation("raster", 2, 2, (1.0, 2.0), 0.5, 100), ss.integrated("st", 24, 30, extra="WHERE it = 100"))
_BACK = "greatest((s.u - h.value) * k.value, 0) + s.u * (1 - k.value)"
for _name, _problem, _first in (("tgvk", Variation(3, solvers.default_alpha(3), 1.0), "backward"), ("tgv3", Variation(3, (1.0, 2.0, 3.0), 1.0, "l1", "forward"), "forward"), ("tgv2", Variation(2, (1.0, 2.0), 1.0), "backward")):
    _add(f"i9_deshade_{_name}", lambda s, d, p=_problem: solvers.deshade(fx.img8(s, d), p, 50, _mask8(s, d), clamp=True, background=True),
         _PARTS.format(m=" * k.value", d=_BACK, v="", s="st s", j=_MASKS, n=50), fx.IMG8, fx.MASK8, ss.variation("img8", 2, _problem.order, _problem.alpha, 1.0, 50, first=_first), ss.integrated("st", 8, 8, extra="WHERE it = 50"))
for _name, _order, _alpha in (("i10_deshade_masked", 2, (1.0, 2.0)), ("i10_deshade_masked_tgvk", 4, solvers.default_alpha(4))):
    _add(_name, lambda s, d, o=_order, a=_alpha: solvers.deshade_masked(fx.img8(s, d), _mask8(s, d), o, a, 1.0, 50),
         _PARTS.format(m=" * k.value", d="(s.u - h.value) * k.value", v="", s="st s", j=_MASKS, n=50), fx.IMG8, fx.MASK8, _MASKED8, ss.variation("masked", 2, _order, _alpha, 1.0, 50, mask="m"), ss.integrated("st", 8, 8, extra="WHERE it = 50"))
_add("i12_convergence_history", lambda s, d: solvers.convergence_history(fx.img8(s, d), Variation(2, (1.0, 2.0), 1.0), [10, 20, 30]), """
SELECT image_id, it AS iteration, round(covar_pop(value, before) / (stddev_samp(value) * stddev_samp(before)), 6) + 0.0 AS ncc, round(sum(abs(value - before)), 6) + 0.0 AS change
FROM (SELECT *, lag(value) OVER (PARTITION BY image_id, x, y ORDER BY it) AS before FROM shading) WHERE it > 10 GROUP BY image_id, it""",
     fx.IMG8, ss.variation("img8", 2, 2, (1.0, 2.0), 1.0, 30), ss.integrated("st", 8, 8, key="image_id, it", extra="WHERE it IN (10, 20, 30)"))
_add("i13_solve_poisson_cg", lambda s, d: solvers.solve_poisson_cg(transforms.remove_zero_frequency(fx.vol4(s, d)), steps=20), V.format("u") + "cg WHERE it = 20",
     fx.VOL4, "centred AS MATERIALIZED (SELECT image_id, x, y, z, value - avg(value) OVER (PARTITION BY image_id) AS value FROM vol4)", ss.poisson_cg("centred", 20, 1e-6))
def _supply(s: SparkSession, d: str) -> DataFrame:
    """Suppliers by parts: every line of lineitem under its own keys."""
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_discount").alias("val"))


def _balances(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("val"))


_SUPPLY = "m0 AS (SELECT l_suppkey AS row, l_partkey AS col, l_discount AS val FROM lineitem)"
_ORDERED = "m0 AS (SELECT l_orderkey AS row, l_partkey AS col, l_discount AS val FROM lineitem)"
_SYMMETRIC = "(SELECT row, col, val FROM m0 UNION ALL SELECT col, row, val FROM m0)"
_TWICE_BY_SYMMETRIC = f"""
SELECT a.row, b.col, round(sum(a.val * b.val), 6) + 0.0 AS val FROM (SELECT row, col, 2 * sum(val) AS val FROM m0 GROUP BY row, col) a
JOIN (SELECT row, col, sum(val) AS val FROM {_SYMMETRIC} GROUP BY row, col) b ON a.col = b.row GROUP BY a.row, b.col"""


def _twice_by_symmetric(m: DataFrame) -> DataFrame:
    return solvers.matrix_multiply(solvers.matrix_add(m, m), solvers.matrix_add(solvers.transpose(m), m))


_add("i14_spmv", lambda s, d: solvers.spmv(solvers.matrix_add(_supply(s, d), solvers.transpose(_supply(s, d))), _balances(s, d)), f"""
SELECT row AS i, round(sum(m.val * s.s_acctbal), 6) + 0.0 AS val FROM {_SYMMETRIC} m JOIN supplier s ON s.s_suppkey = m.col GROUP BY row""", _SUPPLY)
_add("i14_matrix_multiply", lambda s, d: _twice_by_symmetric(_supply(s, d)), _TWICE_BY_SYMMETRIC, _SUPPLY)


def _whole_matrix(s: SparkSession, d: str) -> DataFrame:
    """Orders by parts: every line of lineitem under its own keys."""
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_discount").alias("val"))


_add("i14_spmv_whole", lambda s, d: solvers.spmv(solvers.matrix_add(_whole_matrix(s, d), solvers.transpose(_whole_matrix(s, d))), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("val"))), f"""
SELECT row AS i, round(sum(m.val * p.p_retailprice), 6) + 0.0 AS val FROM {_SYMMETRIC} m JOIN part p ON p.p_partkey = m.col GROUP BY row""", _ORDERED)
_add("i14_matrix_multiply_whole", lambda s, d: _twice_by_symmetric(_whole_matrix(s, d)), _TWICE_BY_SYMMETRIC, _ORDERED)


def _cg(s: SparkSession, d: str, **options) -> DataFrame:
    """Whole keys again: the symmetric part, and a diagonal that makes it positive definite; prices on the right."""
    both = solvers.matrix_add(_whole_matrix(s, d), solvers.transpose(_whole_matrix(s, d)))
    sums = both.groupBy("row").agg(F.sum(F.abs("val")).alias("val"))
    diagonal = sums.select("row", F.col("row").alias("col"), (F.col("val") * 2 + 1).alias("val"))
    prices = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("row"), F.col("p_retailprice").alias("price"))
    f = sums.join(prices, "row", "left").select(F.col("row").alias("i"), F.coalesce("price", F.lit(0.0)).alias("val"))
    return solvers.cg_solve(durable(both.unionByName(diagonal)), f, **options)


_add("i14_cg_solve", _cg)


def _cg_sql(steps: int) -> list[str]:
    """`c0`, `c1`, ...: (i, x, r, p) after each step for the system of _cg."""
    out = [
        _ORDERED,
        f"twice AS MATERIALIZED (SELECT row, col, sum(val) AS val FROM {_SYMMETRIC} GROUP BY row, col)",
        "sums AS MATERIALIZED (SELECT row, sum(abs(val)) AS val FROM twice GROUP BY row)",
        "a AS MATERIALIZED (SELECT row, col, sum(val) AS val FROM (SELECT * FROM twice UNION ALL SELECT row, row, val * 2 + 1 FROM sums) GROUP BY row, col)",
        "c0 AS MATERIALIZED (SELECT row AS i, 0.0::DOUBLE AS x, coalesce(p_retailprice, 0) AS r, coalesce(p_retailprice, 0) AS p FROM sums LEFT JOIN part ON p_partkey = row)",
    ]
    for k in range(steps):
        out += [
            f"ap{k} AS MATERIALIZED (SELECT row AS i, sum(a.val * c.p) AS ap FROM a JOIN c{k} c ON c.i = a.col GROUP BY row)",
            f"n{k} AS MATERIALIZED (SELECT i, x + w * p AS x, r - w * ap AS r, p, rr FROM (SELECT *, rr / (SELECT sum(p * ap) FROM c{k} JOIN ap{k} USING (i)) AS w FROM c{k} JOIN ap{k} USING (i) CROSS JOIN (SELECT sum(r * r) AS rr FROM c{k})))",
            f"c{k + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM n{k}) / rr * p AS p FROM n{k})",
        ]
    return out


_add("i14_cg_solve_steps", lambda s, d: _cg(s, d, eps=1e-30, steps=4), "SELECT i, round(x, 6) + 0.0 AS val FROM c4", *_cg_sql(4))
_add("i15_region_grow", lambda s, d: segments.region_grow(fx.img8(s, d), _values(s, SEED_SCHEMA, *SEEDS)), """
SELECT image_id, x, y, z, coalesce(label, 0) AS label, coalesce(label, 0) > 0 AS edge
FROM img8 LEFT JOIN (SELECT image_id, x, y, z, max(label) AS label FROM (SELECT *, 1 AS label FROM g1 UNION ALL SELECT *, 1 FROM g2 UNION ALL SELECT *, 2 FROM g3) GROUP BY ALL) USING (image_id, x, y, z)""",
     fx.IMG8, ss.grown("img8", tuple((g, x, y, z, t) for g, _, _, x, y, z, t in SEEDS)))

# --- batches

_add("b1_run_sweep", lambda s, d: sweeps.run_sweep(fx.event_raster(s, d), sweeps.parameter_grid(s, [0.5, 1.0], [1.0, 2.0]), 50),
     "SELECT s.image_id, run_id, s.x, s.y, s.z, round(s.u, 6) + 0.0 AS denoised, round(h.value, 6) + 0.0 AS shading, round(s.u - h.value, 6) + 0.0 AS deshaded, true AS passed FROM st s JOIN shading h USING (image_id, run_id, x, y) WHERE s.it = 50",
     fx.EVENTS, """sets AS (SELECT a0, a1, CAST(row_number() OVER (ORDER BY a0, a1) - 1 AS VARCHAR) AS n FROM (VALUES (0.5::DOUBLE), (1.0)) AS p(a0) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0)) AS q(a1)),
swept AS MATERIALIZED (SELECT image_id, image_id || '-' || n AS run_id, x, y, z, value, a0, a1 FROM raster CROSS JOIN sets)""",
     ss.variation("swept", 2, 2, ("a1", "a0"), 1.0, 50, key="image_id, run_id"), ss.integrated("st", 24, 30, key="image_id, run_id", extra="WHERE it = 50"))


def _evaluated(sets: str, iterations: int) -> tuple[str, ...]:
    """`rmetrics` of the raster, and `dmetrics` of what each run of `swept`(image_id, run_id, a0, a1, ...) made of it."""
    return (fx.EVENTS, sets, ss.variation("swept", 2, 2, ("a1", "a0"), "0.5::DOUBLE" if "weight_half" in sets else 1.0, iterations, key="image_id, run_id"),
            ss.integrated("st", 24, 30, key="image_id, run_id", extra=f"WHERE it = {iterations}"),
            f"made AS MATERIALIZED (SELECT run_id, s.image_id, s.x, s.y, s.z, s.u - h.value AS value FROM st s JOIN shading h USING (image_id, run_id, x, y) WHERE s.it = {iterations})",
            _metrics_of("raster", "r", 27), _metrics_of("made", "d", 27, "run_id"))


_RUN_CHANGES = f"SELECT run_id, {_CHANGES} FROM (SELECT DISTINCT run_id, image_id FROM swept) JOIN rmetrics a USING (image_id) JOIN dmetrics b USING (run_id)"
_FOUR = """sets AS (SELECT a0, a1, CAST(row_number() OVER (ORDER BY a0, a1) - 1 AS VARCHAR) AS n FROM (VALUES (0.5::DOUBLE), (1.0)) AS p(a0) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0)) AS q(a1)),
swept AS MATERIALIZED (SELECT image_id, image_id || '-' || n AS run_id, x, y, z, value, a0, a1 FROM raster CROSS JOIN sets)"""
_DECADES = """sets AS (SELECT power(10.0::DOUBLE, -i) AS a0, power(10.0::DOUBLE, -i) * 2 AS a1, CAST(8 - i AS VARCHAR) AS n FROM range(0, 9) AS r(i)),
swept AS MATERIALIZED (SELECT image_id, image_id || '-' || n AS run_id, x, y, z, value, a0, a1, 'weight_half' AS note FROM raster CROSS JOIN sets)"""
_add("b2_evaluate_runs", lambda s, d: sweeps.evaluate_runs(fx.event_raster(s, d), sweeps.run_sweep(fx.event_raster(s, d), sweeps.parameter_grid(s, [0.5, 1.0], [1.0, 2.0]), 50)), _RUN_CHANGES, *_evaluated(_FOUR, 50))
_add("b4_alpha_scan", lambda s, d: sweeps.alpha_scan(fx.event_raster(s, d), [10.0**-i for i in range(9)], 2.0, 0.5, 30), _RUN_CHANGES, *_evaluated(_DECADES, 30))


def _task_list(s: SparkSession, d: str) -> DataFrame:
    """Four tasks for every image of the events, one a mode, written as a task file and read back."""
    modes = F.array(*map(F.lit, ("SubtractFromInput", "SubtractFromInput|NotMasked", "SubtractFromDenoised|Color", "SubtractFromDenoised|NotMasked")))
    ids = fx.event_raster(s, d).select("image_id").distinct()
    name = lambda kind: F.concat(F.lit(kind), F.col("image_id").cast("string"))
    numbers = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    rows = ids.select(
        F.lit("events").alias("data_directory"), name("image ").alias("input"), name("mask ").alias("mask"), F.explode(modes).alias("mode"),
        numbers(2, 3, 0).alias("line_start"), numbers(20, 17, 0).alias("line_end"), F.lit(0.5).alias("f_downsampling"), F.lit(0.5).alias("lambda"),
        F.lit(50).alias("iteration_count"), numbers(1, 4).alias("alpha"),
    )
    path = shared_dir(s)
    files.write_tasks(rows, path)
    return files.read_tasks(s, path)


def _evaluated_tasks(s: SparkSession, d: str) -> DataFrame:
    raster = fx.event_raster(s, d)
    low = F.col("image_id") * 2
    both = durable(raster.withColumn("image_id", low).unionByName(fx.mask_of(raster).withColumn("image_id", low + 1)))
    ids = both.select("image_id").distinct()
    kind = F.when(F.col("image_id") % 2 == 0, "image ").otherwise("mask ")
    names = ids.select(F.concat(kind, F.floor(F.col("image_id") / 2).cast("string")).alias("name"), "image_id")
    listed = durable(tasks.bind_tasks(_task_list(s, d).withColumn("task_id", F.xxhash64("input", "mode")), names))
    found = tasks.evaluate_tasks(listed, both, durable(tasks.run_tasks(listed, both)), 32, 0.0, 400.0)
    return found.join(listed.select("task_id", "input", "mode"), "task_id").drop("task_id")


_add("b2_evaluate_tasks", _evaluated_tasks)
_add("s9_read_tasks", lambda s, d: _task_list(s, d).select("data_directory", "input", "mask", "mode", *(F.col(c)[i].alias(f"{c}_{i}") for c in ("line_start", "line_end") for i in range(3)), "f_downsampling", F.col("lambda").alias("weight"), "iteration_count", F.col("alpha")[0].alias("alpha_0"), F.col("alpha")[1].alias("alpha_1")), """
SELECT 'events' AS data_directory, 'image ' || image_id AS input, 'mask ' || image_id AS mask, mode, 2.0::DOUBLE AS line_start_0, 3.0::DOUBLE AS line_start_1, 0.0::DOUBLE AS line_start_2,
       20.0::DOUBLE AS line_end_0, 17.0::DOUBLE AS line_end_1, 0.0::DOUBLE AS line_end_2, 0.5::DOUBLE AS f_downsampling, 0.5::DOUBLE AS weight, 50 AS iteration_count, 1.0::DOUBLE AS alpha_0, 4.0::DOUBLE AS alpha_1
FROM (SELECT DISTINCT image_id FROM cells) CROSS JOIN (VALUES ('SubtractFromInput'), ('SubtractFromInput|NotMasked'), ('SubtractFromDenoised|Color'), ('SubtractFromDenoised|NotMasked')) AS m(mode)""", fx.EVENTS)


def _written_seeds(s: SparkSession, d: str) -> DataFrame:
    """A segment for every nation and a seed for every supplier, written as a seed file and read back."""
    nations = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = s.read.parquet(f"{d}/supplier.parquet").join(F.broadcast(nations), "s_nationkey")
    seeds = rows.select(
        (F.col("s_nationkey") + 1).cast("int").alias("segment_id"), F.col("n_name").alias("name"), F.col("s_suppkey").alias("seed_no"),
        F.col("s_suppkey").cast("int").alias("x"), F.col("s_nationkey").cast("int").alias("y"), F.lit(0).alias("z"), F.col("s_acctbal").alias("tolerance"),
    )
    path = shared_dir(s)
    files.write_seeds(seeds, path, 0.5)
    return files.read_seeds(s, path).select("name", "seed_no", "x", "y", "z", "tolerance")


_add("s6_write_read_seeds", _written_seeds, "SELECT replace(n_name, ' ', '') AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS seed_no, CAST(s_suppkey AS INTEGER) AS x, CAST(s_nationkey AS INTEGER) AS y, 0 AS z, round(s_acctbal, 6) + 0.0 AS tolerance FROM supplier JOIN nation ON n_nationkey = s_nationkey")


def _exported(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s)
    files.export_columns(_runs(s, d), ["id", "alpha0", "metric"], path)
    return s.read.csv(path, sep=" ", header=True, schema="id long, alpha0 double, metric double")


_add("s8_export_columns", _exported, "SELECT id, round(alpha0, 6) + 0.0 AS alpha0, round(metric, 6) + 0.0 AS metric FROM runs", RUNS)


def _coloured(s: SparkSession, d: str) -> DataFrame:
    """b, g, r of 0 to 255 from three embeddings' worth of numbers, and twice the grey value as the new channel."""
    byte = lambda c: F.floor(F.least(F.lit(255.0), F.abs(c) * 400)).cast("int")
    pair = fx.pair8(s, d).withColumnRenamed("value", "other")
    both = fx.img8(s, d).join(pair, KEY)
    template = both.select(*KEY, byte(F.col("value")).alias("b"), byte(F.col("other")).alias("g"), byte(F.col("value") + F.col("other")).alias("r"))
    return files.with_value_channel(fx.img8(s, d).select(*KEY, F.floor(F.abs("value") * 800).cast("double").alias("value")), template)


_BYTE = "CAST(floor(least(255.0::DOUBLE, abs({}) * 400)) AS INTEGER)"
_NEW = "greatest(0, least(255, floor(abs(value) * 800)))"
_CHANNEL = f"CAST(trunc(CASE WHEN greatest(b, g, r) = 0 THEN {_NEW} ELSE {{0}}::DOUBLE * {_NEW} / greatest(b, g, r) END) AS INTEGER) AS {{0}}"
_add("s5_with_value_channel", _coloured, f"""
SELECT image_id, x, y, z, {', '.join(_CHANNEL.format(c) for c in 'bgr')} FROM (SELECT a.image_id, a.x, a.y, a.z, a.value, {_BYTE.format('a.value')} AS b, {_BYTE.format('p.value')} AS g, {_BYTE.format('a.value + p.value')} AS r
FROM img8 a JOIN pair8 p USING (image_id, x, y, z))""", fx.IMG8, fx.PAIR8)
_add("u1_map_voxels", lambda s, d: map_voxels(fx.img8(s, d), lambda v: v * v + 1), V.format("value * value + 1") + "img8")
_add("u2_zip_voxels", lambda s, d: zip_voxels(fx.img8(s, d), fx.pair8(s, d), lambda a, b: F.greatest(a, b)), JOINED.format("greatest(a.value, b.value)"), fx.IMG8, fx.PAIR8)
_add("u3_is_dense", lambda s, d: is_dense(fx.img8(s, d), headers(fx.img8(s, d))), "SELECT vec_id AS image_id, true AS dense FROM embeddings")
_add("u4_dense_grid", lambda s, d: dense_grid(headers(fx.vol4(s, d))), "SELECT image_id, x, y, z FROM vol4", fx.VOL4)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
