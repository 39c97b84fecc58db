"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition makes one *run*: its distinct digests, each with the identifier that stays and a count.
In each round `fan_in` neighbouring runs exchange their entries and are merged into one (a binomial tree with
multiway merges), so equal digests meet level by level and an entry is reduced before every exchange. A run is spread
over the cluster by its digests, so the last run is not one task. A merge is a sort aggregate: a task sorts the entries
that it received, as Spark has no operator that merges the sorted blocks of a shuffle, and passes over equal neighbours
once, without a hash table; what does not fit into memory is spilled as sorted runs and merged. Then the tree is walked
back down: each run learns its survivors from the run it was merged into. A digest has at most `fan_in` entries below
one parent and at most one input partition's rows below one leaf, so a group of copies of any size never meets in one
task.

An entry is merged only when SHA-256, the byte length and a second, independent 64-bit hash of the text all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, durable

KEY = ["sha", "n_bytes", "second"]


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, run, sha, n_bytes, second) for each row; a null text counts as the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("second"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null equals the empty text. Of equal texts the row with the `keep`
    ("largest" or "smallest") id stays; rows that repeat its id as well stay too. Null ids lose against others; a
    group of null ids only keeps them. Other columns of docs are ignored, whatever their names. No rows give no rows.
    """
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep is largest or smallest, fan_in at least 2")
    # A struct, which also makes the aggregates sort aggregates; null where all ids are null.
    best = lambda c: (F.max if keep == "largest" else F.min)(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"))))

    rows = durable(digest_rows(docs, id_col, text_col))
    levels = [durable(rows.groupBy("run", *KEY).agg(best("id").alias("best"), F.count(F.lit(1)).alias("n")))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        merged = levels[-1].groupBy(F.expr(f"run div {fan_in}").cast("int").alias("run"), *KEY)
        levels.append(durable(merged.agg(best("best.id").alias("best"), F.sum("n").alias("n"))))
        runs = -(-runs // fan_in)

    known = levels.pop()
    while levels:
        below = levels.pop().select("run", *KEY).withColumn("parent", F.expr(f"run div {fan_in}").cast("int"))
        known = below.join(known.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return rows.join(known, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs with one row of each text, the one that exact_groups keeps, with all columns. A text whose ids are all null
    keeps a row too; of rows that repeat the kept id and text one stays. A row is dropped by its id and its text together,
    so an id with several texts loses only those kept elsewhere."""
    groups = exact_groups(docs, id_col, text_col, keep).select(F.col(id_col).alias("__id"), "kept", F.unhex("text_sha256").alias("__sha"))
    dropped = durable(groups.groupBy("__id", "__sha").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    gone, twice = dropped.where(~F.col("kept")).select("__id", "__sha"), dropped.where("kept and n > 1").select("__id", "__sha")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS // 4 else df
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    here = lambda x: x["__id"].eqNullSafe(F.col(f"`{id_col}`")) & (x["__sha"] == sha)
    rest = docs.join(small(gone), here(gone), "left_anti")
    if twice.isEmpty():
        return rest
    once = rest.join(small(twice), here(twice), "left_anti")
    # All rows of a group that repeats are equal in id and text: the first in any order stays.
    name = next(f"__sha{i}" for i in range(len(docs.columns) + 1) if f"__sha{i}" not in docs.columns)
    again = rest.join(small(twice), here(twice), "left_semi").withColumn(name, sha)
    return once.unionByName(again.dropDuplicates([id_col, name]).drop(name))
