"""Registered queries by name, and the SQL that gives the same rows.

Values are rounded to six places and 0.0 is added on both sides, so that -0.0 and the order of sums do not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    places = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return df.select(*(places(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, run: Query, sql: str | None = None, *tables: str) -> None:
    """sql: a SELECT over the common table expressions in tables, by default the 8 x 8 images."""
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = f"WITH RECURSIVE {', '.join(tables or (fx.IMG8,))}\n{sql.strip()}"


def shown(value: str, source: str) -> str:
    """SELECT of a voxel table with a rounded value."""
    return f"SELECT image_id, x, y, z, round({value}, 6) + 0.0 AS value FROM {source}"
