"""Embedding whitening: principal components of unit variance, from exact integer moments.

Entries become integers, so sums and products of the covariance are exact and the same whatever the
partitions or the order in which lost tasks are run again. The eigenvectors of the small covariance
come from slicing its spectrum (``spectrum``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spectrum import leading_eigenpairs

#: An entry c becomes floor(SCALE * c) + OFFSET; SCALE * c saturates at MOST.
SCALE, OFFSET, MOST = 64, 1_000_000, 1 << 40
#: Largest sum of squares that doubles, and that longs, hold without rounding or overflow.
_EXACT_DOUBLE, _EXACT_LONG = 1 << 53, 1 << 62


def finite_vectors(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """``vec_id, v`` and more columns of rows whose vector, as doubles, is not null and has finite entries only.

    Vectors of another length than the most frequent one (the shorter, of equally frequent ones) and
    vectors without entries take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def scaled(v: str, scale: int, offset: int = 0, most: int = MOST) -> F.Column:
    """floor(scale * entry) + offset of every entry, as longs; scale * entry saturates at ``most``."""

    def one(c: F.Column) -> F.Column:
        wide = F.greatest(F.least(c * float(scale), F.lit(float(most))), F.lit(float(-most)))
        return F.floor(wide).cast("long") + F.lit(offset).cast("long")

    return F.transform(v, one)


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """The vectors of a list column without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _sum_tasks(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> dict[tuple[int, int], int]:
    """Sums of ``work`` (a matrix of Python integers for each block of vectors) over all rows of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            i, j = (a.ravel() for a in np.indices(shape))
            sums = pa.array([Decimal(int(s)) for s in total.ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), sums], ["i", "j", "s"])

    # one row an entry of the matrix, whatever the number of rows or tasks
    summed = rows.select("x").mapInArrow(run, "i long, j long, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r.i, r.j): int(r.s) for r in summed.toLocalIterator()}


def exact_products(z: np.ndarray) -> np.ndarray:
    """z'z of integers as Python integers; doubles multiply as long as they are exact."""
    most = int(np.abs(z).max()) ** 2 * len(z)
    return (z.astype(np.float64).T @ z.astype(np.float64)).astype(np.int64).astype(object) if most < _EXACT_DOUBLE else z.astype(object).T @ z.astype(object)


def fit_moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number, sums by dimension and covariance (divisor n) of the vectors ``x``.

    Products are of entries less the rounded mean, summed exactly; the covariance is rounded once.
    """
    first = fit.select("x").head()
    if first is None:
        return 0, [], np.empty((0, 0))
    d = len(first["x"])

    def count_and_sum(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(object).sum(axis=0), [len(x)]])[None, :]

    got = _sum_tasks(fit, count_and_sum, (1, d + 1))
    n, sums = got[0, d], [got[0, i] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    off = [s - n * c for s, c in zip(sums, centre)]
    middle = np.array(centre, dtype=np.int64)
    products = _sum_tasks(fit, lambda x: exact_products(x - middle), (d, d))
    v = np.array([[(n * products[i, j] - off[i] * off[j]) / (n * n) for j in range(d)] for i in range(d)])
    return n, sums, v


def whiten(
    vectors: DataFrame,
    components: int = 16,
    scale: int = SCALE,
    offset: int = OFFSET,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row a vector and component.

    Each entry c becomes x = floor(scale * c) + offset. Mean and covariance (divisor ``n``) are over the ``n``
    distinct vectors x, with sums S; ``whitened`` is (x - S/n) projected on the unit eigenvector, over the
    root of its eigenvalue; ``explained`` is the eigenvalue's share of the trace; ``deviation`` is the exact
    sum of (n x - S)^2 over dimensions, at most the largest long; ``identity_error`` is the largest entry of
    the whitened covariance minus the identity, measured over the distinct vectors.

    Rows whose vector is null, empty or holds null or non-finite entries, or has another length than most,
    have no result; null ids do; repeated rows come as often as they were. Directions without variance
    have no component, so fewer than two distinct vectors, or none, give an empty result.

    The distinct vectors are written once to the shared folder; the driver sees sums, of a size that depends on
    the dimension alone, and decomposes a matrix of dimension times dimension.
    """
    rows = finite_vectors(vectors, id_col, vec_col).select("vec_id", scaled("v", scale, offset).alias("x"))
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    n, sums, v = fit_moments(fit)
    values, axes = leading_eigenpairs(v, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    to_white = axes / np.sqrt(values)
    explained = values / np.trace(v)
    total = np.array(sums, dtype=object)
    most_sum = max(abs(s) for s in sums)

    def apart(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if n * int(np.abs(x).max()) + most_sum < _EXACT_LONG:
            return n * x - total.astype(np.int64)
        return n * x.astype(object) - total

    def whitened(y: np.ndarray) -> np.ndarray:
        return (y / n).astype(np.float64) @ to_white

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k))  # sums, then sums of products
        for batch in batches:
            if batch.num_rows:
                w = whitened(apart(matrix(batch.column(0))))
                held[0] += w.sum(axis=0)
                held[1:] += w.T @ w
        i, j = (a.ravel() for a in np.indices(held.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(held.ravel())], ["i", "j", "s"])

    held = np.zeros((k + 1, k))
    for r in fit.mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (k + 1) k rows
        held[r.i, r.j] = r.s
    mean = held[0] / n
    error = float(np.abs(held[1:] / n - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = apart(matrix(batch.column(1)))
            if y.dtype == object or y.shape[1] * int(np.abs(y).max()) ** 2 >= _EXACT_LONG:
                y = y.astype(object)
                deviation = np.array([min(int(s), (1 << 63) - 1) for s in (y * y).sum(axis=1)], dtype=np.int64)
            else:
                deviation = (y * y).sum(axis=1)
            b = batch.num_rows
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(b), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)),
                pa.array(np.full(b * k, n, dtype=np.int64)),
                pa.array(np.repeat(deviation, k)),
                pa.array(whitened(y).ravel()),
                pa.array(np.tile(explained, b)),
                pa.array(np.full(b * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
