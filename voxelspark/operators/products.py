"""Products of sparse matrices (row, col, val) in tiles.

A product has many more terms than entries, so terms are made, and summed, in the task that writes their cells: rows of
the left matrix go to blocks of neighbouring rows, each block gets the rows of the right matrix that it meets, cut by
columns into as many parts as it takes for a part to fit, and what is shuffled is entries, not terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget

#: Entries of a tile from the left and from the right matrix, and terms that are summed at once.
LEFT, RIGHT, TERMS = 1 << 19, 1 << 20, 1 << 21


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's different values, and these; null is one of them."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _known(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0.0).to_numpy(), column.is_valid().to_numpy()


def _cells(left: pa.Table, right: pa.Table, terms: int) -> Iterator[pa.RecordBatch]:
    """The product of a tile, rows of up to `terms` terms (or one row) at a time."""
    keys = pc.unique(right["met"].combine_chunks())
    met = pc.index_in(left["met"].combine_chunks(), value_set=keys)
    left = left.append_column("k", met).filter(met.is_valid())
    right_k = pc.index_in(right["met"].combine_chunks(), value_set=keys).to_numpy()
    row, rows = _codes(left["row"])
    col, cols = _codes(right["col"])
    order = np.argsort(right_k, kind="stable")
    col, (right_val, right_known) = col[order], (a[order] for a in _known(right["val"]))
    ends = np.cumsum(np.bincount(right_k))
    order = np.argsort(row, kind="stable")
    row, k, (val, known) = row[order], left["k"].to_numpy()[order], (a[order] for a in _known(left["val"]))
    many = np.diff(ends, prepend=0)[k]
    # A chunk ends with the last row that fits, or after its first one.
    upto, last = np.cumsum(many), np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.empty(0, int)
    done, at = 0, 0
    while at < len(last):
        seen = upto[done - 1] if done else 0
        to = max(at + 1, int(np.searchsorted(upto[last], seen + terms, "right")))
        here = slice(done, last[to - 1] + 1)
        n = many[here]
        first = np.repeat(ends[k[here]] - n - np.cumsum(n) + n, n)
        other = first + np.arange(len(first))
        cell = np.repeat(row[here], n) * len(cols) + col[other]
        term = np.repeat(val[here], n) * right_val[other]
        there = np.repeat(known[here], n) & right_known[other]
        term[~there] = 0.0
        by = np.argsort(cell, kind="stable")
        cell = cell[by]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        cell, sums, some = cell[starts], np.add.reduceat(term[by], starts), np.logical_or.reduceat(there[by], starts)
        yield pa.RecordBatch.from_arrays([rows.take(pa.array(cell // len(cols))), cols.take(pa.array(cell % len(cols))), pa.array(sums, mask=~some)], names=["row", "col", "val"])
        done, at = here.stop, to


def product(a: DataFrame, b: DataFrame, left: int = LEFT, right: int = RIGHT, terms: int = TERMS) -> DataFrame:
    """a times b as (row, col, val double), with a cell where an entry of each meets. A term of a null is left out of its
    sum, which is null without any other. The entries of one row of a, and its terms in a part of the columns, fit a task."""
    number = F.col("val").cast("double").alias("val")
    entries = durable(a.where("col is not null").select("row", F.col("col").alias("met"), number))
    others = durable(b.where("row is not null").select(F.col("row").alias("met"), "col", number))
    n = max(1, -(-entries.count() // left))
    blocks = durable(entries.repartitionByRange(n, "row").withColumn("block", F.spark_partition_id()))
    forget(entries)
    needed = durable(blocks.select("block", "met").distinct().join(others.groupBy("met").agg(F.count(F.lit(1)).alias("n")), "met"))
    parts = durable(needed.groupBy("block").agg(F.ceil(F.sum("n") / right).cast("int").alias("parts")))
    tiles = parts.agg(F.sum("parts")).first()[0] or 1
    lefts = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rights = needed.join(others, "met").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("col"), F.col("parts")).cast("int"))
    row, col = (F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((a, "row"), (b, "col")))
    sent = lefts.select("block", "part", F.lit(True).alias("left"), "row", "met", col, "val").unionByName(rights.select("block", "part", F.lit(False).alias("left"), row, "met", "col", "val"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches))
        yield from _cells(tile.filter(tile["left"]), tile.filter(pc.invert(tile["left"])), terms)

    schema = f"row {a.schema['row'].dataType.simpleString()}, col {b.schema['col'].dataType.simpleString()}, val double"
    return sent.repartition(tiles, "block", "part").groupBy("block", "part").applyInArrow(multiply, schema)
