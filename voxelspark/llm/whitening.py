"""Whitening of embeddings by block Golub-Kahan-Lanczos bidiagonalisation.

The rows x, as whole numbers, are centred exactly: z = (n x - S) / n, with n and the sums S as integers. The left
vectors U (n rows, b a block) are never stored: each block is Z W for a small matrix W, so a pass computes what it needs
of U from its rows. A step takes two passes over the rows:

* Zv: the block V of right vectors (D x b) gives T = Z W', where W' has the parts along the earlier U removed; a QR
  of T, task by task and then of the tasks' triangles, gives the new block of U;
* Zᵀu: the products of Z with the new block, and with them U's inner products, by which the block is orthogonalised
  against all earlier ones a second time.

The next V is what these products have beyond all V so far, orthogonalised twice. UᵀZV is block bidiagonal; its small
singular value decomposition yields components (V times its right vectors) and deviations (its values over sqrt(n)).
Blocks of b vectors instead of single ones read the rows b times less often. Steps end when nothing new is left, which
D / b of them always reach, or when the wanted triplets' residuals are below rounding.

What reaches the driver: D sums, and for each step b x b a task, D x b and (steps b) x b numbers, for any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget

SCALE, SHIFT = 1024, 100_000
#: Relative size below which a direction is rounding error.
TINY = 1e-12
LARGEST = 2.0**63 * (1 - 1e-9)


@dataclass
class Whitening:
    """n rows with sums S; components (k x D, unit), their eigenvalues, the trace of the covariance, and the largest error
    of the whitened rows' covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    error: float = 0.0


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): floor(scale * entry) + shift as longs, of the rows with a vector of finite entries only; written once."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    fit = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", bad))
    return durable(fit.select("id", F.transform("c", lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long")).alias("x")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * np.int64(n) - sums).astype(float) / n


def _summed(rows: DataFrame, n: int, sums: np.ndarray, size: int, run: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches z of centred rows of run(z), `size` numbers."""
    sent = rows.sparkSession.sparkContext.broadcast((n, sums))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += run(_centred(_matrix(batch.column(0), len(sent.value[1])), *sent.value)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _triangle(rows: DataFrame, n: int, sums: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The triangle R of Z w = Q R."""
    sent = rows.sparkSession.sparkContext.broadcast((n, sums, w))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, w = sent.value
        r = np.zeros((0, w.shape[1]))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _centred(_matrix(batch.column(0), len(sums)), n, sums) @ w]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    found = rows.select("x").mapInArrow(part, "r binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(r["r"]).reshape(-1, w.shape[1]) for r in found]), mode="r")


def _orthogonal(v: np.ndarray, against: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what v has beyond the columns of `against`, without directions below TINY * scale."""
    for _ in range(2):
        v = v - against @ (against.T @ v)
    u, s, _ = np.linalg.svd(v, full_matrices=False)
    u = u[:, s > TINY * scale]
    for _ in range(2):  # small directions are cleaned again
        u = np.linalg.qr(u - against @ (against.T @ u))[0]
    return u


def fit_whitening(rows: DataFrame, k: int = 8, block: int = 8, seed: int = 1) -> Whitening | None:
    """From whole_numbers: the k components of largest variance, fewer where the variance has fewer directions. None without rows.

    Vectors of several lengths are an error.
    """
    n, shortest, d = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if shortest != d:
        raise ValueError(f"vectors have from {shortest} to {d} entries")
    totals = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    exact = [0] * d
    for r in totals:
        exact[r["i"]] = r["v"]
    sums = np.array(exact, np.int64)
    trace = float(_summed(rows, n, sums, 1, lambda z: np.array([(z * z).sum()]))[0]) / n
    done = Whitening(n, exact, np.zeros((0, d)), np.zeros(0), trace)
    if trace == 0:
        return done

    norm = np.sqrt(trace * n)  # of Z, above its largest singular value
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(block, d))))[0]
    vs, ws, zs = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, W with U = Z W, and Zᵀ U
    while v.shape[1]:
        w = v - ws @ (zs.T @ v)
        vs = np.hstack([vs, v])
        left, s, right = np.linalg.svd(_triangle(rows, n, sums, w))
        kept = s > TINY * norm
        w = w @ right[kept].T / s[kept]
        b, before = w.shape[1], ws.shape[1]
        if b:
            every = np.hstack([ws, w])
            found = _summed(rows, n, sums, (d + before + b) * b, lambda z, every=every, b=b: (lambda u: np.vstack([z.T @ u[:, -b:], u.T @ u[:, -b:]]))(z @ every)).reshape(-1, b)
            z, inner = found[:d], found[d:]
            slip = inner[:before]
            w, z = w - ws @ slip, z - zs @ slip
            root = np.linalg.inv(np.linalg.cholesky(inner[before:] - slip.T @ slip)).T
            ws, zs = np.hstack([ws, w @ root]), np.hstack([zs, z @ root])
        u, sigma, vt = np.linalg.svd(zs.T @ vs)
        if b and vs.shape[1] < d:
            rest = zs[:, -b:] - vs @ (vs.T @ zs[:, -b:])
            if len(sigma) >= k and np.linalg.norm(rest @ u[-b:, :k], axis=0).max() <= 1e-15 * sigma[0]:
                break
            v = _orthogonal(zs[:, -b:], vs, norm)
        else:
            v = np.zeros((d, 0))
    keep = sigma[:k] > TINY * norm
    done.components = (vt[: len(sigma)][:k] @ vs.T)[keep]
    done.eigenvalues = sigma[:k][keep] ** 2 / n
    c = len(done.eigenvalues)
    to = done.components.T / np.sqrt(done.eigenvalues)
    moments = _summed(rows, n, sums, c * c, lambda z: (lambda y: y.T @ y)(z @ to)).reshape(c, c) / n
    done.error = float(np.abs(moments - np.eye(c)).max()) if c else 0.0
    return done


def whiten(vectors: DataFrame, k: int = 8, block: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each input row with a usable vector and each component, from 1: id_col, component, n, deviation, whitened,
    explained, identity_error.

    Entries c count as floor(1024 c) + 100000. Rows whose vector is null, empty, or holds a null or an entry that is not
    finite are left out, and are not fitted on. Null and repeated ids keep their rows; equal vectors count as often as
    they come; other columns are ignored. Components without variance are not returned, so that equal vectors only, or no
    rows, give no rows. Components of equal variance are one of many bases. deviation is exact, and null where it is
    beyond a long. Vectors of several lengths are an error.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors, id_col, vector_col)
    fitted = fit_whitening(rows, k, block)
    if fitted is None or not len(fitted.eigenvalues):
        forget(rows)
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        sums, c = np.array(f.sums, np.int64), len(f.eigenvalues)
        to = f.components.T / np.sqrt(f.eigenvalues)
        for batch in batches:
            x = _matrix(batch.column(1), len(sums))
            off = x * np.int64(f.n) - sums
            fits = (off.astype(float) ** 2).sum(axis=1) < LARGEST
            deviation = pa.array((off * off).sum(axis=1), mask=~fits)
            y = (off.astype(float) / f.n) @ to
            at = pa.array(np.repeat(np.arange(len(x)), c))
            fixed = [np.tile(np.arange(1, c + 1, dtype=np.int32), len(x)), np.full(len(x) * c, f.n), y.ravel(), np.tile(f.eigenvalues / f.trace, len(x)), np.full(len(x) * c, f.error)]
            component, n, whitened, explained, error = map(pa.array, fixed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), component, n, deviation.take(at), whitened, explained, error], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
