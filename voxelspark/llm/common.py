"""Helpers that the training-data operators share: tables, durable intermediate results, expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable, forget, shared_dir  # noqa: F401  the operators take them from here

#: Java and RE2 pattern of the white space that separates words: space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Ids (8 bytes each) up to which a table of ids is broadcast.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of texts.
TEXTS = 1000


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs hand texts to Python in batches of TEXTS rows at most, so that a worker holds a few MB of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(TEXTS, int(before)) if int(before) > 0 else TEXTS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable) -> Callable:
    """run, a function of the Arrow batches of a task, after which the worker gives unused memory back to the system."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return after


def tidy_group(run: Callable) -> Callable:
    """As tidy, for a function of the Arrow table of a group."""

    def after(group: pa.Table) -> pa.Table:
        out = run(group)
        give_back()
        return out

    return after


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most `most` bytes in the column, or one row."""
    i, sizes = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    while i < batch.num_rows:
        j, size = i + 1, int(sizes[i])
        while j < batch.num_rows and size + sizes[j] <= most:
            size += int(sizes[j])
            j += 1
        yield batch.slice(i, j - i)
        i = j


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body refers to it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id_col is in gone (one column, id_col). Null ids are kept.

    gone is broadcast while it is small, so that the texts stay where they are; beyond that, both sides are shuffled.
    """
    gone = durable(gone.where(F.col(id_col).isNotNull()).distinct().withColumnRenamed(id_col, "__gone"))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col] == gone["__gone"], "left_anti")
