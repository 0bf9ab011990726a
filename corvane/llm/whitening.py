"""Embedding whitening by a randomised range finder.

Components become whole numbers, floor(scale * component) + shift, so that sums are exact. Then a random block of a few more
directions than components are asked for is multiplied by the covariance again and again, one pass over all centred rows each
time, and made orthonormal in between: it turns towards the range of the leading eigenvectors. Rayleigh-Ritz in that block gives
the components and what they miss, |Vu - eu|. If that is not going to fall to rounding in the passes allowed, as with eigenvalues
that lie close together, the block grows to the full dimension, where one more pass is exact.

A pass adds up, in each task, a matrix of dimension by block width; the matrices meet by a sum per entry, not in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS, OVERSAMPLING, PASSES = 8, 8, 6
#: Residuals up to this share of the largest eigenvalue are rounding; variances up to it are none.
ROUNDING = 1e-12


def shifted_units(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * component) + shift of every component as long; null for vectors that are null, empty or hold null or
    non-finite components."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(sound & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(shift)))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the difference n * x - S is exact before it becomes a double."""
    return (x * n - sums) / n


def _summed(rows: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the matrices that `task` makes of the batches: each task adds up its own, then a sum per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += task(batch)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, pa.float64())], names=["at", "value"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.select("x").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def _ritz(block: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k leading Ritz values and vectors of a symmetric matrix in an orthonormal block, from the block's image under it; the
    largest residual as a share of the largest value."""
    small = block.T @ image
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
    vectors = block @ inner
    missed = np.linalg.norm(image @ inner - vectors * values, axis=0).max(initial=0)
    return values, vectors, missed / max(values.max(initial=0), np.finfo(float).tiny)


def components(rows: DataFrame, n: int, sums: np.ndarray, *, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, eigenvectors as columns, largest residual, passes made) of the covariance of the rows' x, by falling value."""
    width = len(sums)
    random = np.random.default_rng(seed)
    size = min(width, k + oversampling)
    block = np.linalg.qr(random.standard_normal((width, size)))[0]
    before = None
    for made in range(1, passes + 2):

        def task(batch: pa.RecordBatch, block=block) -> np.ndarray:
            c = _centred(_rows(batch, width), n, sums)
            return c.T @ (c @ block)

        image = _summed(rows, task, block.shape) / n
        values, vectors, missed = _ritz(block, image, min(k, width))
        if missed <= ROUNDING or block.shape[1] == width:
            break
        hopeless = before is not None and missed * (missed / before) ** (passes - made) > ROUNDING
        before = missed
        if made < passes and not hopeless:
            block = np.linalg.qr(image)[0]
        else:  # the whole space, its first directions those found so far
            block = np.linalg.qr(np.concatenate([np.linalg.qr(image)[0], random.standard_normal((width, width - size))], axis=1))[0]
    return values, vectors, missed, made


def whiten(vectors: DataFrame, *, k: int = COMPONENTS, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding", oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """(doc, component, n, deviation, whitened, explained, identity_error) for each row and component, numbered from 1 by falling
    eigenvalue, at most k.

    n counts the rows fitted on, which are all that remain; deviation is the sum over dimensions of (n * x - S) ** 2, exact, and
    an error beyond 64 bits; whitened is the row's centred projection over the root of the eigenvalue; explained the eigenvalue's
    share of the trace; identity_error the largest entry of whitened's covariance less the identity, over all rows.
    Vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another width than most
    (of equally many, the wider stay). Repeated rows and ids, null ids: each row counts. Components of no variance, as of equal
    or single rows, are left out; without any, and for an empty table, there are no rows. Other columns, whatever their names, are
    not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("doc"), shifted_units(F.col(f"`{vector_col}`"), scale, shift).alias("x")).where("x IS NOT NULL")
    rows = materialize(rows, "whole_numbers")
    kind = rows.schema["doc"].dataType.simpleString()
    out_type = f"doc {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).limit(2).collect()
    if not widths:
        return rows.sparkSession.createDataFrame([], out_type)
    width, n = widths[0]["w"], widths[0]["count"]
    rows = rows.where(F.size("x") == width) if len(widths) > 1 else rows

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            x = _rows(batch, width)
            total, most = total + x.sum(axis=0), max(most, int(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(np.full(width, most))], names=["at", "total", "most"])

    added = rows.select("x").mapInArrow(add_up, "at bigint, total bigint, most bigint").groupBy("at").agg(F.sum("total").alias("total"), F.max("most").alias("most")).orderBy("at").collect()
    sums, most = np.array([r["total"] for r in added], dtype=np.int64), added[0]["most"]
    if 2 * most * n >= 2**63:
        raise ValueError("sums do not fit 64 bits")
    values, axes, _, _ = components(rows, n, sums, k=k, oversampling=oversampling, passes=passes)
    trace = float(_summed(rows, lambda b: (_centred(_rows(b, width), n, sums) ** 2).sum(axis=0), (width,)).sum()) / n
    real = values > max(trace, 0) * ROUNDING
    values, axes = values[real], axes[:, real]
    count = len(values)
    if not count:
        return rows.sparkSession.createDataFrame([], out_type)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(count)] < 0, -1, 1)  # one sign in every run
    turn = axes / np.sqrt(values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        z = _centred(_rows(batch, width), n, sums) @ turn
        return np.concatenate([z.T @ z, z.sum(axis=0, keepdims=True)])

    seen = _summed(rows, moments, (count + 1, count)) / n
    error = float(np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(count)).max())
    shares = values / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, width)
            apart = x * n - sums
            exact = (apart.astype(np.float64) ** 2).sum(axis=1)
            if exact.max(initial=0) >= 2.0**63:
                raise ValueError("deviations do not fit 64 bits")
            deviation = (apart**2).sum(axis=1)
            z = (apart / n) @ turn
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(np.repeat(np.arange(m), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, dtype=np.int64)),
                    pa.array(np.repeat(deviation, count)), pa.array(z.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * count, error)),
                ],
                names=["doc", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(emit, out_type)
