"""Whitening of embeddings from an exact integer scatter matrix.

An entry c becomes the integer x = floor(64 c) + SHIFT. The fit list is each distinct x
vector once, written to the shared folder. Tasks subtract the shift and add up sums and
cross-products without rounding: products are taken of 20-bit limbs in blocks of rows
whose sums stay below 2^53, so matrix products of doubles are exact, and totals are
Python integers. A task sends its totals as limbs of 32 bits, which Spark sums by cell.
Only d (d + 3) / 2 + 1 totals reach the driver, however many rows there are; it forms
n X'X - S S' exactly, converts it to doubles, and decomposes it by eigh. Two passes
follow: the covariance of the whitened fit list, and the rows.

Cases. Rows are dropped whose vector is null or empty, or holds an entry that is null,
not finite, or so large that x is no usable long (64 c of 2^62 or more, either sign). Vectors whose
length is not the most usual one (the longest of several such) have no common dimensions
with the fit list and are dropped too. Repeated rows stay, each with its own result, and
count once in the fit. Null ids stay null. Components without variance (an eigenvalue
that is rounding error beside the largest) cannot be scaled and are left out, so equal
vectors alone, or an empty table, give no row. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shared import written

SCALE, SHIFT = 64, 1_000_000
_LIMB, _ROWS = 20, 8192  # 2^19 * 2^19 * 8192 is below 2^53
_CELL = pa.schema([("cell", pa.int64()), ("limb", pa.int64()), ("value", pa.int64())])


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of 20 bits as doubles, the least first: y is their sum, each times 2^20 to its place."""
    out, half = [], 1 << (_LIMB - 1)
    while True:
        low = ((y + half) & ((1 << _LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> _LIMB
        if not y.any():
            return out


def cross_products(y: np.ndarray) -> np.ndarray:
    """y'y of int64 rows, in Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a in range(0, len(y), _ROWS):
        parts = _limbs(y[a : a + _ROWS])
        for i, left in enumerate(parts):
            for j, right in enumerate(parts[i:], i):
                product = (left.T @ right).astype(np.int64)
                total += (product if i == j else product + product.T).astype(object) << (_LIMB * (i + j))
    return total


def column_sums(y: np.ndarray) -> np.ndarray:
    """Sums of the columns of int64 rows, in Python integers."""
    high = y >> 32
    return (high.sum(axis=0).astype(object) << 32) + (y - (high << 32)).sum(axis=0).astype(object)


def _shifted(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - SHIFT


def _totals(d: int):
    """Rows (cell, limb, value) of a task's count, sums and cross-products. Limbs have 32 bits and the sign of the total."""
    upper = np.triu_indices(d)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = _shifted(batch)
            n += len(y)
            sums += column_sums(y)
            products += cross_products(y)
        cells: list[tuple[int, int, int]] = []
        for cell, total in enumerate([n, *sums, *products[upper]]):
            sign, rest, limb = (-1 if total < 0 else 1), abs(int(total)), 0
            while rest:
                cells.append((cell, limb, sign * (rest & 0xFFFFFFFF)))
                rest, limb = rest >> 32, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells, strict=True)] if cells else [pa.array([], pa.int64())] * 3, schema=_CELL)

    return rows


def exact_scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, n X'X - S S') of a column x of d longs, less the shift, in Python integers. The matrix is the same with the shift."""
    cells = fit.select("x").mapInArrow(_totals(d), "cell long, limb long, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect()
    totals = [0] * (1 + d + d * (d + 1) // 2)
    for r in cells:
        totals[r.cell] += r.value << (32 * r.limb)
    n, sums = totals[0], np.array(totals[1 : d + 1], dtype=object)
    products = np.zeros((d, d), dtype=object)
    upper = np.triu_indices(d)
    products[upper] = totals[d + 1 :]
    products.T[upper] = totals[d + 1 :]
    return n, sums, n * products - np.outer(sums, sums)


def decomposed(n: int, scatter: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of scatter / n^2, the largest ``most`` that are more than rounding error."""
    values, vectors = np.linalg.eigh(np.array([[int(x) / n**2 for x in row] for row in scatter], dtype=np.float64))
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values[:most] > max(values[0], 0) * len(values) * 1e-15
    return values[:most][some], vectors[:, :most][:, some]


class _Centred:
    """n x - S of a batch, exactly."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums
        self.most = max((abs(int(s)) for s in sums), default=0)

    def __call__(self, y: np.ndarray) -> np.ndarray:
        largest = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
        if self.n * largest + self.most < 1 << 62:
            return self.n * y - self.sums.astype(np.int64)
        return self.n * y.astype(object) - self.sums


def squared_lengths(z: np.ndarray) -> list[int | None]:
    """Exact sums of the squares of each row; None where a long does not hold one."""
    largest = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
    if z.dtype != object and largest**2 * z.shape[1] < 1 << 63:
        return (z * z).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (z.astype(object) ** 2).sum(axis=1)]


def _moments(centred: _Centred, scaled: np.ndarray):
    """Rows (cell, value): sums of the whitened coordinates and of their products."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = scaled.shape[1]
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (centred(_shifted(batch)).astype(np.float64) / centred.n) @ scaled
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())})

    return rows


def identity_error(fit: DataFrame, centred: _Centred, scaled: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = scaled.shape[1]
    cells = fit.select("x").mapInArrow(_moments(centred, scaled), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1) * k)
    for r in cells:
        total[r.cell] = r.value
    total = total.reshape(k + 1, k) / centred.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def _whitened(centred: _Centred, scaled: np.ndarray, explained: np.ndarray, error: float):
    k = scaled.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            z = centred(_shifted(batch))
            deviation = pa.array(squared_lengths(z), pa.int64())
            w = (z.astype(np.float64) / centred.n) @ scaled
            each = pa.array(np.repeat(np.arange(m), k))
            columns = {
                "vec_id": batch.column("vec_id").take(each),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, centred.n)),
                "deviation": deviation.take(each),
                "whitened": pa.array(w.ravel()),
                "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that can be used, x as longs."""
    c = F.col("embedding").cast("array<double>")
    usable = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < 2.0**62 / SCALE), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.size("c") > 0).where(F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of vectors (vec_id, embedding) and up to ``components`` components."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.select("vec_id", "embedding"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == usual.d)
    fit = written(rows.select("x").distinct(), "fit")
    n, sums, scatter = exact_scatter(fit, usual.d)
    values, vectors_ = decomposed(n, scatter, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    trace = sum(int(scatter[i, i]) for i in range(usual.d)) / n**2
    scaled, centred = vectors_ / np.sqrt(values), _Centred(n, sums)
    error = identity_error(fit, centred, scaled)
    return rows.mapInArrow(_whitened(centred, scaled, values / trace, error), schema)
