"""Whitening of embeddings: leading principal components, each scaled to unit variance.

Entries are put on an integer grid, x = floor(1024 c) + 100000, so counts, sums and the
deviations from the mean are exact whatever the order they are added in.

1. One pass counts the vectors and sums each dimension.
2. One pass adds up (x - m)(x - m)^T, with m the mean rounded to the grid; a task sends one
   matrix, and matrices are added row by row. What rounding left is taken off afterwards,
   so the covariance is that of centred vectors, with divisor n. All terms are integers,
   exact up to 2**53.
3. The driver holds that one matrix (dimensions squared, at most ``MOST`` by ``MOST``):
   Householder reflections make it tridiagonal, Sturm counts bisect for the leading
   eigenvalues, inverse iteration finds their vectors, and those of eigenvalues that lie
   close together are made orthogonal to each other before they are turned back.
4. The components are broadcast (``COMPONENTS`` vectors) and every vector is projected.

Defined results: vectors that are null or empty or hold null or non-finite entries are left
out, as are entries beyond ``FARTHEST`` on the grid, which have no exact place in it; where
lengths differ, only those of the most frequent length count (ties: the longer). Components
whose eigenvalue is zero up to rounding don't exist, so fewer than ``COMPONENTS`` may come;
equal vectors, one vector alone and an empty table give no rows. Rows of equal ids are
vectors of their own; null ids stay null; further columns are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FARTHEST = 1 << 52
MOST = 4096
EPS = np.finfo(np.float64).eps
PARTS = 64  # sums of the tasks' matrices are added in so many groups a row first
ROWS = 1024  # vectors that are worked on at once


def on_grid(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column whose vectors are kept, and those vectors as integers."""
    if not isinstance(column, pa.ListArray):
        column = column.cast(pa.list_(column.type.value_type))
    counts = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(counts == size)
    if not len(rows):
        return rows, np.zeros((0, size), np.int64)
    flat = column.take(pa.array(rows)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # null entries are NaN
    x = np.floor(c * SCALE) + SHIFT
    with np.errstate(invalid="ignore"):
        kept = (np.abs(x) <= FARTHEST).all(axis=1)
    return rows[kept], x[kept].astype(np.int64)


def parts_of(batches: Iterator[pa.RecordBatch], place: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, *on_grid(part.column(place), size)


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of a vector (ties: the longest); 0 without vectors."""
    sizes = vectors.groupBy(F.size("v").alias("size")).count().where("size > 0")
    found = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def fitted_sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for _, _, x in parts_of(batches, 0, size):
            n += len(x)
            total = total + x.sum(axis=0, dtype=np.int64)  # 2**10 entries of 2**52 at most
        total = [Decimal(int(t)) for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(total, pa.decimal128(38, 0)), pa.array(np.full(size, n))], names=["d", "s", "n"]
        )

    rows = vectors.mapInArrow(run, "d int, s decimal(38,0), n bigint").groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = {r.d: int(r.s) for r in rows}
    return (rows[0].n, [sums[d] for d in range(size)]) if rows else (0, [])


def fitted_covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix, from centred vectors, divisor n."""
    size = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    schema = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("row", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, _, x in parts_of(batches, 0, size):
            y = (x - middle).astype(np.float64)
            total += y.T @ y
        part = np.full(size, TaskContext.get().partitionId() % PARTS, np.int32)
        for at in range(0, size, 256):
            rows = [r.tobytes() for r in total[at : at + 256]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(rows), dtype=np.int32)), pa.array(part[: len(rows)]), pa.array(rows, pa.binary())], schema=schema
            )

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for row in group.column(2):
            total += np.frombuffer(row.as_buffer(), np.float64)
        one = group.slice(0, 1).select([0, 1])
        return one.append_column(schema.field(2), pa.array([total.tobytes()], pa.binary()))

    form = "i int, part int, row binary"
    rows = vectors.mapInArrow(run, form)
    rows = rows.groupBy("i", "part").applyInArrow(added, form).groupBy("i").applyInArrow(added, form).collect()
    matrix = np.zeros((size, size))
    for r in rows:
        matrix[r.i] = np.frombuffer(r.row, np.float64)
    left = np.array([float(s - n * int(m)) / n for s, m in zip(sums, middle)])
    return matrix / n - np.outer(left, left)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    a = matrix.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        length = np.linalg.norm(v)
        mirrors.append(v / length if length > 0 else v)
        v = mirrors[-1]
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        if length > 0:
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def turned_back(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Columns given for the tridiagonal matrix, for the one that it was made of."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def below(diagonal: np.ndarray, side: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Eigenvalues below each point: the negative pivots of the shifted matrix (Sturm count)."""
    least = np.finfo(np.float64).tiny * max(1.0, float((side**2).max(initial=0)))
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(np.int64)
    with np.errstate(over="ignore"):  # a tiny pivot makes the next one infinite, and all is well after it
        for d, e in zip(diagonal[1:], side):
            pivot = np.where(np.abs(pivot) < least, -least, pivot)
            pivot = d - points - e * e / pivot
            count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    around = np.concatenate([[0], np.abs(side), [0]])
    reach = around[:-1] + around[1:]
    n = len(diagonal)
    low = np.full(wanted, (diagonal - reach).min())
    high = np.full(wanted, (diagonal + reach).max() * (1 + 4 * EPS) + np.finfo(np.float64).tiny)
    rank = n - np.arange(1, wanted + 1)  # eigenvalues below the one that is sought
    for _ in range(2000):
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            break
        over = below(diagonal, side, middle) > rank
        high, low = np.where(over & open_, middle, high), np.where(~over & open_, middle, low)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, side: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """(T - value I)^-1 right by elimination with row exchanges; tiny pivots are set apart from 0."""
    n = len(diagonal)
    least = EPS * max(np.abs(diagonal).max(), np.abs(side).max(initial=0), np.finfo(np.float64).tiny)
    d, up = diagonal - value, np.append(side, 0.0)
    up2, x = np.zeros(n), right.copy()
    for k in range(n - 1):
        low = side[k]
        if abs(low) > abs(d[k]):  # the next row is the better pivot row
            x[k], x[k + 1] = x[k + 1], x[k]
            f = d[k] / low
            d[k], next_d, next_up = low, up[k] - f * d[k + 1], -f * up[k + 1]
            up[k], up2[k], d[k + 1], up[k + 1] = d[k + 1], up[k + 1], next_d, next_up
        else:
            if abs(d[k]) < least:
                d[k] = least
            f = low / d[k]
            d[k + 1] -= f * up[k]
        x[k + 1] -= f * x[k]
    if abs(d[-1]) < least:
        d[-1] = least
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < n:
            x[k] -= up2[k] * x[k + 2]
        x[k] /= d[k]
    return x


def leading_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column, by inverse iteration.

    Each iterate is made orthogonal to the vectors of its cluster: values that follow each
    other at less than a thousandth of the matrix's size.
    """
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max() + 2 * np.abs(side).max(initial=0)), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(7)  # starting vectors: any will do, the same each time
    out = np.zeros((n, len(values)))
    head = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            head = k
        shift = value - (k - head) * 4 * EPS * size  # equal values start apart
        x = rng.standard_normal(n)
        for _ in range(8):
            for _ in range(2):  # the second time takes off what rounding left
                x -= out[:, head:k] @ (out[:, head:k].T @ x)
            x = solved(diagonal, side, shift, x / np.linalg.norm(x))
        for _ in range(2):
            x -= out[:, head:k] @ (out[:, head:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def components(covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns); those of value zero are left out."""
    n, size = len(covariance), float(np.abs(covariance).max(initial=0))
    if not size:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, side, mirrors = tridiagonal(covariance / size)
    values = leading_values(diagonal, side, min(wanted, n))
    values = values[values > 8 * n * EPS * values[0]]
    vectors = turned_back(leading_vectors(diagonal, side, values), mirrors)
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; null past 38 digits."""
    if not len(x):
        return []
    s = np.array(sums, object)
    reach = max(abs(int(x.min())), abs(int(x.max()))) * n + max(abs(v) for v in sums)
    if reach < 1 << 62:
        y = x * n - s.astype(np.int64)
        most = int(np.abs(y).max())
        y = y if most * most * len(sums) < 1 << 63 else y.astype(object)
    else:
        y = x.astype(object) * n - s
    return [Decimal(int(v)) if v < 10**38 else None for v in (y * y).sum(axis=1).tolist()]


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """``(<id_col>, component, n, deviation decimal(38,0), whitened, explained, identity_error)``
    for each vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    form = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    both = vectors.select(F.col(id_col).alias("k"), F.col(vector_col).cast("array<double>").alias("v"))
    alone = both.select("v")
    size = dimension(alone)
    if size > MOST:
        raise ValueError(f"vectors of more than {MOST} dimensions: the covariance matrix would not fit the driver")
    n, sums = fitted_sums(alone, size) if size else (0, [])
    if not n:
        return spark.createDataFrame([], form)
    covariance = fitted_covariance(alone, n, sums)
    values, axes = components(covariance, wanted)
    if not len(values):
        return spark.createDataFrame([], form)
    mean = np.array([s // n + (s % n) / n for s in sums])
    explained = values / np.trace(covariance)
    sent = spark.sparkContext.broadcast((mean, axes / np.sqrt(values)))
    m = len(values)

    def projected(x: np.ndarray) -> np.ndarray:
        mean, scaled = sent.value
        return (x - mean) @ scaled

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((m, m)), np.zeros(m)
        for _, _, x in parts_of(batches, 0, size):
            y = projected(x)
            total += y.T @ y
            first += y.sum(axis=0)
        i, j = np.indices((m, m)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1)), pa.array(first[i])], names=["i", "j", "s", "f"])

    error = 0.0
    rows = alone.mapInArrow(squares, "i int, j int, s double, f double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("f").alias("f")).collect()
    first = {r.i: r.f / n for r in rows}  # zero but for rounding; taken off all the same
    for r in rows:
        error = max(error, abs(r.s / n - first[r.i] * first[r.j] - (r.i == r.j)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in parts_of(batches, 1, size):
            y = projected(x)
            row = np.repeat(np.arange(len(rows)), m)
            deviation = pa.array(deviations(x, n, sums), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows[row])), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(row), n)), deviation.take(pa.array(row)), pa.array(y.reshape(-1)),
                pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(row), error)),
            ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return both.mapInArrow(run, form)
