"""Connected components by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) -> (id, component): every id that has a link, with the smallest id that links reach.

    Each round hooks every vertex to its smallest neighbour, jumps twice along the hooks and contracts the graph, so
    that its vertices at least halve. Only tables move; nothing is gathered by component.
    """
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        hook = ends.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("to"))
        hook = durable(hook)
        jump = hook.alias("x").join(hook.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to"))
        known = jump if known is None else known.withColumnRenamed("to", "id").join(jump, "id", "left").select("first", F.coalesce("to", "id").alias("to"))
        known = durable(known if "first" in known.columns else known.withColumnRenamed("id", "first"))
        moved = edges.join(jump.select(F.col("id").alias("a"), F.col("to").alias("c")), "a").join(jump.select(F.col("id").alias("b"), F.col("to").alias("d")), "b")
        edges = durable(moved.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        if edges.isEmpty():
            return known.select(F.col("first").alias("id"), F.col("to").alias("component"))
