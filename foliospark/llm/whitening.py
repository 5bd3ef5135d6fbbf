"""Whitening of integer vectors with exact sums and products.

Entries become integers, x = floor(scale * c) + shift.  Three passes over the vectors:

1. sums of x per dimension, exact, give the centre S / n;
2. y = n * x - S is split into signed limbs of `LIMB` bits.  Products of limb matrices over at most `BLOCK` rows stay below
   2 ** 53, so float64 BLAS gives them exactly.  Each task recombines them as big integers and returns its matrix in words of
   60 bits; Spark adds the words of all tasks as decimals (with map-side sums), and the driver, which holds one matrix of
   dimensions x dimensions, recombines these: sum(y y') is exact, whatever the partitions;
3. the covariance sum(y y') / n ** 3, each entry rounded once, is eigendecomposed, and each vector is projected.

Between 2 and 3 one more pass adds up the products of the whitened vectors themselves; `identity_error` is the largest
difference of their covariance from the identity.

Rows whose vector is null or holds a null, NaN or infinity are left out.  Vectors shorter than the longest one count as
filled up with zeros (c = 0); an empty vector is one of zeros.  |scale * c| is bounded by 2 ** 61, so x fits a long.
A deviation beyond a long is null.  Directions without variance (an eigenvalue within rounding of 0) cannot be whitened and
are no components; so one row, or equal rows alone, give an empty result, as does an empty table.  Ids pass as they are:
null, repeated, of any type.  Extra columns are left out.  Memory of a task: one batch and one matrix.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import table

SCALE, SHIFT = 64, 1_000_000
LIMB, BLOCK, WORD = 18, 1 << 16, 60
SAFE = 1 << 61
WORDS = "i int, j int, word int, value long"


@dataclass(frozen=True)
class Fit:
    """n vectors, their sums, and the components by falling eigenvalue: axes has one column each."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def matrix(column: pa.Array, dims: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The integers of a batch of vectors, one row each, as longs."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    c = np.zeros((len(column), dims))
    c[np.arange(dims)[None, :] < ends[:, None]] = flat
    return np.floor(np.clip(scale * c, -SAFE, SAFE)).astype(np.int64) + shift


def largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums down the columns, of Python's integers where longs could overflow."""
    return x.sum(axis=0) if largest(x) * len(x) < SAFE else x.astype(object).sum(axis=0)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly."""
    small = largest(x) * n + max(map(abs, sums), default=0) < SAFE
    return x * np.int64(n) - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of y in base 2 ** LIMB, lowest first, each within half the base, as float64."""
    out, half = [], 1 << (LIMB - 1)
    while largest(y):
        low = ((y + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as big integers, through exact float64 products of limbs."""
    dims = y.shape[1]
    total = np.zeros((dims, dims), object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        for a, low in enumerate(parts):
            for b in range(a, len(parts)):
                p = (low.T @ parts[b]).astype(np.int64).astype(object)
                total = total + ((p if a == b else p + p.T) << (LIMB * (a + b)))
    return total


def to_words(value: int) -> list[int]:
    """A big integer in words of WORD bits, lowest first; each has the number's sign."""
    sign, left, out = (-1 if value < 0 else 1), abs(value), []
    while left:
        out.append(sign * (left & ((1 << WORD) - 1)))
        left >>= WORD
    return out


def _words(entries: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = [(i, j, k, w) for i, j, v in entries for k, w in enumerate(to_words(int(v)))]
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "word", "value"])


def _merged(df: DataFrame) -> dict[tuple[int, int], int]:
    """Adds the words of all tasks; what reaches the driver is a matrix, whatever the number of rows."""
    out: dict[tuple[int, int], int] = {}
    for r in df.groupBy("i", "j", "word").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.v) << (WORD * r.word))
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds numbers alone."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    odd = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.withColumn(vector, v).filter(F.col(vector).isNotNull() & ~odd)


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Fit:
    """Centre, covariance and components of usable vectors."""
    only = vectors.select(F.col(vector).alias("v"))
    n, dims = only.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or not dims:
        return Fit(n, (), np.zeros(0), np.zeros((dims, 0)), 0.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for b in batches:
            total = total + exact_sum(matrix(b.column(0), dims, scale, shift)).astype(object)
        yield _words((0, j, v) for j, v in enumerate(total))

    at = _merged(only.mapInArrow(add, WORDS))
    sums = tuple(at.get((0, j), 0) for j in range(dims))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for b in batches:
            total = total + gram(centred(matrix(b.column(0), dims, scale, shift), n, sums))
        yield _words((i, j, total[i, j]) for i in range(dims) for j in range(i, dims))

    at = _merged(only.mapInArrow(multiply, WORDS))
    cov = np.array([[at.get((min(i, j), max(i, j)), 0) / n**3 for j in range(dims)] for i in range(dims)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > 8 * dims * np.finfo(float).eps * max(values[0], 0.0)
    lead = np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None, :], axis=0)
    axes = axes * np.where(lead < 0, -1.0, 1.0)  # the largest entry of each axis is positive
    return Fit(n, sums, values[real], axes[:, real], float(np.trace(cov)))


def project(x: np.ndarray, by: Fit, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitened coordinates, and y = n * x - sums."""
    y = centred(x, by.n, by.sums)
    k = min(components, len(by.values))
    return (y / by.n).astype(np.float64) @ by.axes[:, :k] / np.sqrt(by.values[:k]), y


def identity_error(vectors: DataFrame, by: Fit, components: int, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    dims, k = by.axes.shape[0], min(components, len(by.values))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w, _ = project(matrix(b.column(0), dims, scale, shift), by, components)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "value"])

    total = np.zeros((k + 1, k))
    for r in vectors.select(vector).mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[k] / by.n
    return float(np.abs(total[:k] / by.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v")
    by = fit(rows, "v", scale, shift)
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    dims, k = by.axes.shape[0], min(components, len(by.values))
    error = identity_error(rows, by, components, "v", scale, shift) if k else 0.0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, y = project(matrix(b.column(1), dims, scale, shift), by, components)
            y = y if largest(y) ** 2 * dims < SAFE else y.astype(object)
            far = pa.array([v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))], pa.int64())
            coordinates = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), far, coordinates], ["id", "deviation", "w"])

    done = rows.mapInArrow(each, out) if k else df.sparkSession.createDataFrame([], out)
    shares = F.array(*[F.lit(float(v / by.trace)) for v in by.values[:k]]).cast("array<double>")
    long = done.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
