"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Points are parts of groups of equal texts, weighted by their bytes. A node is split at the weighted median along its
widest metadata dimension until every leaf is one shard of the target bytes. Dimensions are the size, the source and the
language, each in the order of their bytes in the corpus, and the id; how wide a node is along one of them is the weighted
deviation of its points against that of all points, so no dimension is wide by its units.

The medians of all nodes of a level are found together by radix descent: histograms of at most 4,096 bins a node, summed
up in order, refined until the bin that holds the cut is light. The driver has a row for each node of a level, which is
at most a row a shard; points carry the first leaf and the number of leaves of their node.

A group of equal texts is a run of at most SALTS neighbouring points in the order along every dimension. So it comes into
one shard unless a cut falls into it; each cut divides one group at most, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget

DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")
BITS, TIE_BITS, RADIX = 30, 33, 12
#: Parts that a group of equal texts may be divided into; the bits of a point's tie that number them.
SALTS, SALT_BITS = 1024, 10
#: Nodes of a level, or categories (a row each), up to which their table is broadcast to the points.
BROADCAST_NODES = 100_000


def _key(dim: Column) -> Column:
    """Coordinate first, then the group's hash and the part: one order in which equal coordinates have an order too."""
    coordinate = F.col(DIMENSIONS[0])
    for k, d in enumerate(DIMENSIONS[1:], 1):
        coordinate = F.when(dim == k, F.col(d)).otherwise(coordinate)
    return coordinate * F.lit(1 << TIE_BITS) + F.col("tie")


def _moments() -> list[Column]:
    x = lambda d: F.col(d) / float(1 << BITS)
    return [F.sum("w").alias("w"), *(F.sum(F.col("w") * x(d) * p).alias(f"{d}_{k}") for d in DIMENSIONS for k, p in ((1, F.lit(1.0)), (2, x(d))))]


def _deviations(r) -> list[float]:
    return [max(0.0, r[f"{d}_2"] / r["w"] - (r[f"{d}_1"] / r["w"]) ** 2) ** 0.5 for d in DIMENSIONS]


def _with_nodes(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    nodes = points.sparkSession.createDataFrame(rows, f"first int, {schema}")
    return points.join(F.broadcast(nodes) if len(rows) <= BROADCAST_NODES else nodes, "first")


def _cuts(points: DataFrame, scale: list[float], tolerance: float) -> list[tuple[int, int, int]]:
    """(first, dimension, cut) of every node with more than one leaf: keys up to the cut go to the lower half."""
    inner, found, open_ = points.where("leaves > 1"), [], {}
    for r in inner.groupBy("first", "leaves").agg(*_moments()).collect():
        wide = [round(x / s, 9) if s > 0 else -1.0 for x, s in zip(_deviations(r), scale, strict=True)]
        open_[r["first"]] = (wide.index(max(wide)), 0, 0, r["w"] * (r["leaves"] // 2) / r["leaves"])  # dimension, prefix, weight below it, target
    shift = BITS + TIE_BITS
    while open_ and shift > 0:
        above, shift = shift, max(0, shift - RADIX)
        here = _with_nodes(inner, [(f, *s) for f, s in open_.items()], "dim int, prefix long, below long, target double").withColumn("key", _key(F.col("dim")))
        bins = here.where(F.shiftright("key", above) == F.col("prefix")).groupBy("first", "below", "target", F.shiftright("key", shift).alias("bin"))
        bins = bins.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("first").orderBy("bin"))
        hits = bins.withColumn("upto", upto).where("upto >= target").groupBy("first").agg(F.min(F.struct("bin", "w", "n", "upto")).alias("h"))
        hit = {r["first"]: r["h"] for r in hits.collect()}
        for first, (dim, _, _, target) in list(open_.items()):
            h = hit.get(first)
            if h is not None and not (h["w"] <= tolerance or h["n"] == 1 or shift == 0):
                open_[first] = (dim, h["bin"], h["upto"] - h["w"], target)
                continue
            # A light bin, or a single point, goes to the nearer side as a whole.
            take = h is not None and h["upto"] - target <= target - (h["upto"] - h["w"])
            cut = (1 << (BITS + TIE_BITS)) - 1 if h is None else ((h["bin"] + take) << shift) - 1
            found.append((first, dim, cut))
            del open_[first]
    return found


def kd_tree(points: DataFrame, n_shards: int, tolerance: float) -> DataFrame:
    """points (w, tie, DIMENSIONS, ...) -> (its other columns, shard). tolerance: bytes that a cut may be off its median."""
    others = [c for c in points.columns if c not in ("w", "tie", *DIMENSIONS)]
    top = points.agg(*_moments()).first()
    scale = _deviations(top) if top["w"] else [0.0] * len(DIMENSIONS)
    points = points.withColumns({"first": F.lit(0), "leaves": F.lit(n_shards)})
    before = None
    for _ in range((n_shards - 1).bit_length()):
        cuts = _cuts(points, scale, tolerance)
        if not cuts:
            break
        half = F.floor(F.col("leaves") / 2).cast("int")
        low = _key(F.col("dim")) <= F.col("cut")
        moved = _with_nodes(points.where("leaves > 1"), cuts, "dim int, cut long")
        moved = moved.withColumns({"first": F.when(low, F.col("first")).otherwise(F.col("first") + half), "leaves": F.when(low, half).otherwise(F.col("leaves") - half)}).select(points.columns)
        after = durable(moved.unionByName(points.where("leaves = 1")))
        forget(before)
        points = before = after
    return points.select(*others, F.col("first").alias("shard"))


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = 16,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    slot_rows: int = 50_000,
) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1; a null text has none. Either n_shards or target_bytes (the bytes that a
    leaf may reach) is given. Shards have nearly equal bytes. Rows of equal texts share a shard unless a cut between two
    shards falls into their group, which is then divided there by hashes of the ids. Null ids, sources and languages count as one value each; equal
    rows get slots of their own; other columns are ignored; no rows give no rows. slot numbers a shard's rows without
    gaps from 0, by buckets of about slot_rows rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    category = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        category(source_col).alias("source"),
        category(lang_col).alias("lang"),
    )
    rows = durable(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    total, n, low, high = rows.agg(F.sum("size"), F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    total, low, high = total or 0, low or 0, high or 0
    if target_bytes is not None:
        n_shards = max(1, -(-total // target_bytes))

    unit = F.lit(float((1 << BITS) - 1))
    groups = durable(rows.groupBy("digest").agg(F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.sum("size").alias("bytes"), F.min("id").alias("id")))
    for c in ("source", "lang"):
        # Categories by their bytes (in steps of 2 ** (1 / 64)), and by a hash of their names where these are alike.
        of = durable(groups.groupBy(c).agg(F.sum("bytes").alias("all")))
        few = F.broadcast if of.count() <= BROADCAST_NODES else (lambda x: x)
        steps = F.least(F.log2(F.col("all").cast("double")) * 64, F.lit(4095.0)).cast("long")
        groups = groups.join(few(of.select(c, (steps * (1 << (BITS - 12)) + F.shiftrightunsigned(F.xxhash64(c), 64 - (BITS - 12))).alias(f"d_{c}"))), c)
    coordinates = groups.select(
        "digest",
        (F.least(F.log2(F.col("size").cast("double")) / 40.0, F.lit(1.0)) * unit).cast("long").alias("d_size"),
        "d_source",
        "d_lang",
        (((F.coalesce("id", F.lit(low)) - F.lit(low)).cast("double") / float(max(1, high - low))) * unit).cast("long").alias("d_id"),
    )
    parts = rows.groupBy("digest", "salt").agg(F.sum("size").alias("w"))
    tie = F.shiftrightunsigned(F.xxhash64("digest"), 64 - (TIE_BITS - SALT_BITS)) * SALTS + F.col("salt")
    points = durable(parts.join(coordinates, "digest").withColumn("tie", tie))
    placed = kd_tree(points, n_shards, tolerance=total / n_shards / 10_000)
    buckets = max(1, -(-n // (slot_rows * n_shards)))
    placed = durable(rows.join(placed, ["digest", "salt"]).select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).alias("bucket")))
    start = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = start.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("id", "crc")
    return (
        placed.withColumn("rank", F.row_number().over(own)).join(start, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
