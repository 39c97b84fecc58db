"""Files: colour images, quantised output, seed lists, run tables, task lists."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KEY
from ..operators.durable import durable, shared_dir
from ..operators.joins import matched
from ..operators.stats import min_max

#: The fields of a task line, in their order.
TASK_FIELDS = ["data_directory", "input", "mask", "mode", "line_start", "line_end", "f_downsampling", "lambda", "iteration_count", "alpha"]


#: Files that the driver lists and plans at a time.
FILES = 20_000


def _listed(spark: SparkSession, *paths: str) -> Iterator[str]:
    """The files under paths (folders, files, patterns), one by one. As for Spark, those whose name begins with _ or . are
    hidden, and of the folders below only those of partitions count. Folders of the driver's machine are read by Python, as
    Hadoop starts a process for each local file, to ask for its owner."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(conf)
        found = store.globStatus(root)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            at = status.getPath()
            top = at.toString()
            if status.isDirectory() and at.toUri().getScheme() == "file":
                yield from (top + name for name in _local(at.toUri().getPath()))
                continue
            files = store.listFiles(at, True)
            while files.hasNext():
                name = files.next().getPath().toString()
                *folders, last = name[len(top) :].strip("/").split("/")
                if last[:1] not in ("_", ".") and all("=" in f for f in folders):
                    yield name


def _local(folder: str) -> Iterator[str]:
    """What _listed asks for of a folder, below it."""
    with os.scandir(folder) as found:
        for entry in found:
            if entry.is_dir():
                if "=" in entry.name:
                    yield from (f"/{entry.name}{name}" for name in _local(entry.path))
            elif entry.name[:1] not in ("_", "."):
                yield f"/{entry.name}"


#: What a file counts when files are dealt to tasks, and tasks that look up the files of a batch. Spark's defaults, 4 MB and
#: a task for each file, are for large files.
OPEN_COST, LOOK_UPS = 1 << 16, 64


@contextmanager
def _small_files(spark: SparkSession) -> Iterator[None]:
    own = {"spark.sql.files.openCostInBytes": OPEN_COST, "spark.sql.sources.parallelPartitionDiscovery.parallelism": LOOK_UPS}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _decoded(spark: SparkSession, paths: tuple[str, ...], columns: list[str]) -> DataFrame:
    """What Spark's image source makes of the files, with image_id: height -1 for one that it cannot decode. Up to FILES
    files are read when needed; more are decoded by so many at a time and kept, so that the driver never has all of them."""
    load = lambda names: spark.read.format("image").load(names).select("image.*").withColumn("image_id", F.xxhash64("origin")).select(*columns)
    names = _listed(spark, *paths)
    batch = list(islice(names, FILES))
    more = list(islice(names, FILES))
    if not more:
        return load(list(paths))
    folder = shared_dir(spark)
    with _small_files(spark):
        while batch:
            part = load(batch)
            part.write.mode("append").parquet(folder)
            batch, more = more, list(islice(names, FILES))
    return spark.read.schema(part.schema).parquet(folder)


#: Columns of the image source that decode_color_images keeps.
DECODED = ["origin", "image_id", "width", "height", "nChannels", "data"]


def decode_color_images(spark: SparkSession, *paths: str) -> DataFrame:
    """The files under the paths, decoded and written once, for list_color_images and read_color_images."""
    with _small_files(spark):
        return durable(_decoded(spark, paths, DECODED))


def list_color_images(spark: SparkSession, *paths: str, decoded: DataFrame | None = None) -> DataFrame:
    """(origin, image_id, width, height, depth, channels, reason) of every file under the paths, or of decoded ones; reason is
    null, or tells why the file has no voxels, and then sizes are null too."""
    good = F.col("height") > 0
    sizes = [F.when(good, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"))]
    raw = _decoded(spark, paths, DECODED[:-1]) if decoded is None else decoded
    return raw.select("origin", "image_id", *sizes, F.when(good, 1).alias("depth"), F.when(good, F.col("nChannels")).alias("channels"), F.when(~good, "not an image").alias("reason"))


def read_color_images(spark: SparkSession, *paths: str, decoded: DataFrame | None = None) -> DataFrame:
    """(origin, image_id, x, y, z, b, g, r, value) of the images under the paths, or of decoded ones; value is the largest
    channel, or the grey value. Files that cannot be decoded have no voxels; list_color_images names them."""
    raw = (_decoded(spark, paths, DECODED) if decoded is None else decoded).where("height > 0")
    cells = raw.select("*", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    byte = lambda c: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * F.col("nChannels") + F.least(F.lit(c), F.col("nChannels") - 1) + 1, F.lit(1))), 16, 10).cast("int")
    cells = cells.select("origin", "image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), F.lit(0).alias("z"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))
    return cells.select("*", F.greatest("b", "g", "r").cast("double").alias("value"))


def with_value_channel(voxels: DataFrame, template: DataFrame) -> DataFrame:
    """(KEY, b, g, r): the template's hue and saturation with the voxels (clamped to 0..255) as value channel. A pixel that
    only one of the two has is an error."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("new.value")))
    both = matched(template.select(*KEY, F.struct("b", "g", "r").alias("old")), voxels.select(*KEY, F.struct("value").alias("new")), "old", "new")
    most = F.greatest("old.b", "old.g", "old.r")
    return both.select(*KEY, *(F.when(most == 0, v).otherwise(F.col(f"old.{c}") * v / most).cast("int").alias(c) for c in "bgr"))


def _png(rows: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes in the order r, g, b."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width, _ = rows.shape
    lines = b"".join(b"\0" + line.tobytes() for line in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_color_images(pixels: DataFrame) -> DataFrame:
    """(image_id, png) from flat pixels (KEY, b, g, r): an image is a row, as it is to be a file."""
    lists = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    flat = lists.select("image_id", "width", *(F.col(f"p.{c}").alias(c) for c in "rgb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            files = [_png(np.stack([np.asarray(c, np.uint8) for c in (r.r, r.g, r.b)], 1).reshape(-1, r.width, 3)) for r in frame.itertuples()]
            yield pd.DataFrame({"image_id": frame["image_id"], "png": files})

    return flat.mapInPandas(run, "image_id long, png binary")


def write_color_images(pixels: DataFrame, path: str) -> DataFrame:
    """Writes `image_id`.png for every image under path, a folder that all executors reach, and gives (image_id, n_bytes).
    A file is written under another name and then moved, so a task that runs again leaves whole files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = FileSystem.from_uri(path)
        store.create_dir(root)
        for frame in frames:
            for image, png in zip(frame["image_id"], frame["png"], strict=True):
                part = f"{root}/_{image}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(png)
                store.move(part, f"{root}/{image}.png")
            yield pd.DataFrame({"image_id": frame["image_id"], "n_bytes": frame["png"].map(len)})

    return durable(encode_color_images(pixels).mapInPandas(run, "image_id long, n_bytes long"))


def quantize(voxels: DataFrame, top: int) -> DataFrame:
    """(KEY, value): each image's range mapped to 0..top and truncated to whole numbers; a constant image becomes 0."""
    span = F.col("max") - F.col("min")
    v = F.when(span == 0, 0.0).otherwise((F.col("value") - F.col("min")) * (F.lit(float(top)) / span))
    return voxels.join(min_max(voxels), "image_id").select(*KEY, v.cast("int").alias("value"))


def write_quantized(voxels: DataFrame, path: str, kind: str = "png") -> None:
    """png: 0..65535, dicom: 0..4096, anything else unchanged; as Parquet."""
    tops = {"png": 65535, "dicom": 4096}
    (quantize(voxels, tops[kind]) if kind in tops else voxels).write.parquet(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, name, seed_no, x, y, z, tolerance). Line 1: the default tolerance; then `name:x|y|z<tol;x|y|z<tol;`,
    a line for each segment; blanks are skipped, a missing tolerance is the default."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.regexp_replace("value", "[ \t\r]", ""), "\n"), lambda x: x != "").alias("lines"))
    parts = lines.select(F.get("lines", 0).cast("double").alias("default"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("i", "line"))
    named = parts.select("default", (F.col("i") + 1).alias("segment_id"), F.split("line", ":")[0].alias("name"), F.filter(F.split(F.split("line", ":")[1], ";"), lambda x: x != "").alias("seeds"))
    each = named.select("default", "segment_id", "name", F.posexplode("seeds").alias("seed_no", "s"))
    at = F.split(F.split("s", "<")[0], r"\|")
    tolerance = F.coalesce(F.get(F.split("s", "<"), 1).cast("double"), F.col("default"))
    return each.select("segment_id", "name", "seed_no", *(at[i].cast("int").alias(a) for i, a in enumerate("xyz")), tolerance.alias("tolerance"))


def seed_lines(seeds: DataFrame) -> DataFrame:
    """(segment_id, value): the text lines that read_seeds reads, without the default."""
    one = F.concat(F.concat_ws("|", "x", "y", "z"), F.lit("<"), F.col("tolerance").cast("string"), F.lit(";"))
    rows = seeds.groupBy("segment_id", "name").agg(F.array_sort(F.collect_list(F.struct("seed_no", one.alias("t")))).alias("all"))
    return rows.select("segment_id", F.concat(F.col("name"), F.lit(":"), F.array_join(F.transform("all", lambda r: r["t"]), "")).alias("value"))


def write_seeds(seeds: DataFrame, path: str, default: float) -> None:
    """One text file; a drawing has few seeds."""
    head = seeds.sparkSession.createDataFrame([(0, str(default))], "segment_id int, value string")
    seed_lines(seeds).unionByName(head).orderBy("segment_id").select("value").coalesce(1).write.text(path)


def insert_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def update_metrics(runs: DataFrame, metrics: DataFrame, names: list[str]) -> DataFrame:
    """runs with the columns of names taken from metrics by id, where there are some."""
    new = metrics.select("id", *(F.col(n).alias(f"new_{n}") for n in names))
    kept: list[Column] = [F.coalesce(F.col(f"new_{n}"), F.col(n)).alias(n) if n in runs.columns else F.col(f"new_{n}").alias(n) for n in names]
    return runs.join(new, "id", "left").select(*(c for c in runs.columns if c not in names), *kept)


def export_columns(runs: DataFrame, columns: list[str], path: str) -> None:
    """Numbers separated by blanks, under a header."""
    runs.select(*columns).write.csv(path, sep=" ", header=True)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """The lines that read_tasks reads, in any number of files; alpha and line ends are arrays of numbers."""
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")) if c in ("alpha", "line_start", "line_end") else F.col(c).cast("string")
    tasks.select(F.concat_ws("; ", *(F.coalesce(text(c), F.lit("")) for c in TASK_FIELDS)).alias("value")).write.text(path)


def _numbers(c: str) -> Column:
    return F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Ten fields separated by `;`, `#` comments and blank lines skipped; alpha and line ends as arrays of numbers."""
    schema = ", ".join(f"`{c}` string" for c in TASK_FIELDS)
    rows = spark.read.csv(path, sep=";", comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    rows = rows.where(F.col("input").isNotNull())
    for c, kind in (("f_downsampling", "double"), ("lambda", "double"), ("iteration_count", "int")):
        rows = rows.withColumn(c, F.col(c).cast(kind))
    return rows.withColumns({c: _numbers(c) for c in ("alpha", "line_start", "line_end")})
