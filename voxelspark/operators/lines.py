"""Weighted sums along lines: each new voxel of an axis is a sum over taps of the old ones. One shuffle of the voxels to the
rows of their lines, however many taps there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES, KEY, by_image

#: New voxels of a line that are made together: a longer line goes over several rows, each with the old voxels it needs.
SEGMENT = 1 << 16
#: Values of lines that are worked on together in a task.
STACK = 1 << 20
#: (n, m, numbers, new places) -> the old places of their taps, in 0..n - 1, and the weights; both (new places, taps).
Taps = Callable[[int, int, tuple[float, ...], np.ndarray], tuple[np.ndarray, np.ndarray]]


def along(voxels: DataFrame, images: DataFrame, axis: str, taps: Taps, reach: int, numbers: tuple[str, ...] = (), scale: str = "1.0", normalised: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(KEY, value) with the lines of one axis made anew. images: (image_id, n, m, numbers): old and new sizes, and numbers
    of the image for taps. scale: new voxels an old one, in SQL; reach: the old voxels at most from a new one's place to a
    tap. normalised: sums are divided by those of the weights.

    Old voxels that are missing take no part; a new one whose taps are all missing is missing too, and null where those
    that are there are null, or weigh nothing together."""
    rest = [c for c in KEY if c != axis]
    sizes = images.select("image_id", F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), *numbers, F.expr(scale).cast("double").alias("scale"))
    sized = voxels.join(by_image(sizes), "image_id").where((F.col(axis) >= 0) & (F.col(axis) < F.col("n")))
    end = F.floor((F.col("m") - 1) / segment)
    part = lambda at: F.least(end, F.greatest(F.lit(0), F.floor(at * F.col("scale") / segment)))
    last = F.when(F.col(axis) == F.col("n") - 1, end).otherwise(part(F.col(axis) + reach + 2))
    first = part(F.col(axis) - reach - 2)
    parts = F.when(F.col("m") <= segment, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    dealt = sized.select(*rest, "n", "m", *numbers, F.explode(parts).alias("part"), F.struct(F.col(axis).alias("at"), "value").alias("p"))
    lines = dealt.groupBy(*rest, "n", "m", *numbers, "part").agg(F.collect_list("p").alias("line"))
    lines = lines.select(*rest, "n", "m", *numbers, "part", F.col("line.at").alias("at"), F.col("line.value").alias("v"))
    keys = ["n", "m", "part", *numbers]

    def work(batch: pa.RecordBatch, n: int, m: int, part: int, own: tuple[float, ...]) -> pa.RecordBatch:
        to = np.arange(part * segment, min(m, (part + 1) * segment))
        places, weights = taps(n, m, own, to)
        low, high = int(places.min()), int(places.max()) + 1
        at, v = batch.column("at"), batch.column("v")
        row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
        at, v = at.flatten().to_numpy() - low, v.flatten()
        here = (at >= 0) & (at < high - low)
        known = ~v.is_null().to_numpy(zero_copy_only=False)
        dense, there, told = (np.zeros((batch.num_rows, high - low)) for _ in range(3))
        np.add.at(dense, (row[here], at[here]), v.fill_null(0.0).to_numpy()[here])
        np.add.at(there, (row[here], at[here]), 1.0)
        np.add.at(told, (row[here], at[here]), known[here])
        total, weight, present, valid = (np.zeros((batch.num_rows, len(to))) for _ in range(4))
        whole = bool((told == 1).all())
        for k in range(places.shape[1]):
            i, w = places[:, k] - low, weights[:, k]
            total += dense[:, i] * w
            if not whole:
                weight, present, valid = weight + there[:, i] * w, present + there[:, i], valid + told[:, i]
        if whole:
            weight += weights.sum(axis=1)
            present += 1
            valid += 1
        if normalised:
            valid[weight == 0] = 0
            total = total / np.where(weight == 0, 1, weight)
        r, c = np.nonzero(present > 0)
        value = pa.array(total[r, c], mask=~(valid[r, c] > 0))
        columns = {axis: pa.array(to[c].astype(np.int32)), "value": value} | {k: batch.column(k).take(pa.array(r)) for k in rest}
        return pa.RecordBatch.from_arrays([columns[k] for k in (*KEY, "value")], names=[*KEY, "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, of = np.unique(np.stack([batch.column(k).to_numpy().astype(float) for k in keys], 1), axis=0, return_inverse=True)
            for k, (n, m, part, *own) in enumerate(kinds.tolist()):
                rows = np.flatnonzero(of.ravel() == k)
                some = max(1, STACK // int(max(min(n, segment), min(m, segment))))
                for i in range(0, len(rows), some):
                    yield work(batch.take(pa.array(rows[i : i + some])), int(n), int(m), int(part), tuple(own))

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in voxels.select(*KEY[:1]).schema] + [f"{a} int" for a in AXES] + ["value double"])
    return lines.mapInArrow(run, schema)
