"""Whitening of embeddings: components of the covariance to double precision, from float32 eigenvectors and matrix products.

Vectors become integers, so counts, sums and deviations are exact. The fit list holds each distinct vector once; its sums and its
centred products are added up in the tasks and then by row of the matrix, so the driver gets a matrix of the dimension's size
and never vectors. Eigenvectors are found in float32 and then corrected by the iteration of Ogita and Aishima: with A the
matrix, X the vectors and D the values, the residual A X - X D and the defect I - X'X are computed from slices whose products
float64 holds exactly, and X grows by X E, E built from both. Values that lie too close for that are solved again inside
their own small space, of the matrix less their mean, where their differences are large.

Defined results: rows whose vector is null, holds a null or a non-finite entry, is empty, or is not of the length that most
rows have (of equal counts the longer) are left out; entries beyond 2**52 in size after scaling are held to it; repeated
rows and equal or null ids keep their rows; further columns play no part; a component without variance has ``whitened`` null
and ``explained`` 0; a deviation beyond 63 bits is null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches
from tallyloom.plans.lineage import cut_lineage

SCALE, COMPONENTS = 64, 16
_LARGEST = 1 << 52
#: Vectors that are centred and multiplied at once.
ROWS_AT_ONCE = 1024


# --- eigenvectors ---


def slices(m: np.ndarray, bits: int) -> list[np.ndarray]:
    """``m`` as a sum of matrices whose entries, column by column, are multiples of a power of two with ``bits`` bits."""
    out, rest = [], np.array(m, np.float64)
    for _ in range(-(-54 // bits) + 1):
        top = np.abs(rest).max(axis=0, initial=0.0)
        if not top.any():
            break
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 53 - bits)
        part = (rest + unit) - unit
        out.append(part)
        rest = rest - part
    return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` in the widest float: the products of slices are exact, and only their sum is rounded."""
    bits = max(1, int((53 - np.ceil(np.log2(max(len(a), 2)))) // 2))
    total = np.zeros((a.shape[1], b.shape[1]), np.longdouble)
    left, right = slices(a, bits), slices(b, bits)
    for k in range(len(left) + len(right) - 1):  # from the largest
        for i, x in enumerate(left):
            if 0 <= k - i < len(right):
                total += x.T @ right[k - i]
    return total


def clusters(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Ranges of falling ``values`` that differ by no more than ``gap`` from their neighbours; of two at least."""
    far = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    bounds = [0, *far.tolist(), len(values)]
    return [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]


def refined_eigenvectors(matrix: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    top, d = np.abs(matrix).max(initial=0.0), len(matrix)
    if not top:
        return np.zeros(d), np.eye(d)
    scale = 2.0 ** np.ceil(np.log2(top))  # a power of two: nothing is rounded
    a = matrix / scale
    found, start = np.linalg.eigh(a.astype(np.float32))
    values, x = found[::-1].astype(np.float64), start[:, ::-1].astype(np.float64)
    norm = float(np.linalg.norm(a, 2)) if d <= 512 else float(np.linalg.norm(a))
    eps, solved, last = np.finfo(np.float64).eps, False, np.inf
    for _ in range(most):
        defect = (np.eye(d) - exact_product(x, x)).astype(np.float64)
        residual = (exact_product(a, x) - x.astype(np.longdouble) * values).astype(np.float64)
        turned = x.T @ residual  # off the diagonal: S + lambda R of the iteration
        values = values + np.diag(turned) / (1 - np.diag(defect))
        residual = (exact_product(a, x) - x.astype(np.longdouble) * values).astype(np.float64)
        turned = x.T @ residual
        # what two values must differ by for their vectors to be told apart by one division
        reach = max(2 * (np.linalg.norm(turned - np.diag(np.diag(turned))) + norm * np.linalg.norm(defect)), 8 * eps * norm)
        order = np.argsort(-values, kind="stable")
        values, x, turned, defect = values[order], x[:, order], turned[np.ix_(order, order)], defect[np.ix_(order, order)]
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= reach
        np.fill_diagonal(near, True)
        step = np.where(near, defect / 2, turned / np.where(near, 1.0, apart))
        x = x + x @ step
        size = float(np.abs(step).max())
        close = clusters(values, reach)
        if size <= 4 * eps * np.sqrt(d) or size >= last / 2 and size < 1e-10:
            if solved or not close:
                break
        last = size
        if size < 1e-6 and close:
            for lo, hi in close:
                x[:, lo:hi], values[lo:hi] = _inside(a, x[:, lo:hi], values[lo:hi])
            solved = True
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.linalg.norm(x, axis=0)


def _inside(a: np.ndarray, x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of close values, turned inside their space so that they are the matrix's own there."""
    middle = float(values.mean())
    shifted = (exact_product(a, x) - x.astype(np.longdouble) * middle).astype(np.float64)
    small = x.T @ shifted
    found, turn = np.linalg.eigh((small + small.T) / 2)
    return x @ turn[:, ::-1], found[::-1] + middle


# --- vectors ---


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a whole vector of ``length`` finite entries, and their integers."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    good = np.nan_to_num(np.asarray(lengths, np.float64), nan=-1) == length
    flat = column.filter(pa.array(good)).flatten()
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    fine = np.isfinite(c).all(axis=1)  # nulls have become nan
    good[np.flatnonzero(good)[~fine]] = False
    x = np.floor(np.clip(c[fine] * SCALE, -_LARGEST, _LARGEST)).astype(np.int64)
    return good, x


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector in the smallest integers that hold it, after a byte that says their size: equal bytes, equal vectors."""
    out: list[bytes] = [b""] * len(x)
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    for size in (1, 2, 4, 8):
        mine = (most < 1 << 8 * size - 1) & ((size == 1) | (most >= 1 << 4 * size - 1))
        rows = np.flatnonzero(mine)
        data = np.column_stack((np.full((len(rows), 1), size, np.uint8), x[rows].astype(f"<i{size}").view(np.uint8).reshape(len(rows), x.shape[1] * size)))
        for k, row in zip(rows.tolist(), data, strict=True):
            out[k] = row.tobytes()
    return out


def unpack(packed: list[bytes], length: int) -> np.ndarray:
    out = np.zeros((len(packed), length), np.int64)
    sizes = np.array([p[0] for p in packed], np.uint8)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[rows] = np.frombuffer(b"".join(packed[k][1:] for k in rows.tolist()), f"<i{size}").reshape(-1, length)
    return out


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact; in Python's integers where 64 bits might not do."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sum_of_squares(scaled: np.ndarray) -> list[int | None]:
    most = int(np.abs(scaled).max(initial=0))
    if scaled.dtype == object or scaled.shape[1] * most * most >= 1 << 63:
        totals = [sum(v * v for v in map(int, row)) for row in scaled]
        return [t if t < 1 << 63 else None for t in totals]
    return (scaled * scaled).sum(axis=1).tolist()


def _length(rows: DataFrame, vector: str) -> int | None:
    """The length that most vectors have; of equal counts the longer one."""
    counts = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("rows"))
    found = counts.agg(F.max(F.struct("rows", "length"))["length"]).first()
    return None if found is None else found[0]


def _added_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Arrays (``line, entries``) added up by line. There are as many lines as dimensions, and a part a partition."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stacked = np.sort(np.stack(rows["entries"].tolist()), axis=0)  # in one order, whatever arrives first
        return pd.DataFrame({"line": [key[0]], "entries": [stacked.sum(axis=0)]})

    return {r["line"]: np.array(r["entries"]) for r in parts.groupBy("line").applyInPandas(add, "line int, entries array<double>").collect()}


class Whitening:
    """Statistics of the fit list and the components: what a task needs to whiten a vector."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums = n, sums
        k = min(COMPONENTS, len(sums))
        good = values[:k] > np.finfo(np.float64).eps * len(sums) * max(values[0], 0)
        self.good, self.vectors = good, vectors[:, :k]
        self.roots = np.sqrt(np.where(good, values[:k], 1.0))
        self.explained = np.where(good, values[:k] / trace if trace else 0.0, 0.0)

    def apply(self, scaled: np.ndarray) -> np.ndarray:
        """Vectors given as ``n x - S``, on the components and over the roots of their variances."""
        return ((scaled / self.n).astype(np.float64) @ self.vectors) / self.roots


def _products(fit: DataFrame, length: int, centred) -> dict[int, np.ndarray]:
    """The sum over the fit list of the outer products of ``centred(x)``, by line."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for k in range(0, len(packed), ROWS_AT_ONCE):
                c = centred(unpack(packed[k : k + ROWS_AT_ONCE], length))
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "entries"])

    return _added_up(fit.mapInArrow(multiply, "line int, entries array<double>"))


def fit_whitening(vectors: DataFrame, length: int) -> tuple[Whitening, float] | None:
    """Components of the distinct ``packed`` vectors, and how far the covariance of what they whiten is from the identity."""
    fit = cut_lineage(vectors.select("packed").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, object)
        for batch in batches:
            x = unpack(batch.column(0).to_pylist(), length)
            n, total = n + len(x), total + x.sum(axis=0)  # a batch holds at most 1,000 vectors: no overflow below 2**53
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, length), pa.int32()), pa.array([str(v) for v in (n, *total.tolist())])], names=["dim", "total"])

    parts = fit.mapInArrow(add, "dim int, total string")
    totals = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    if not totals:
        return None
    n, sums = totals[-1], [totals[k] for k in range(length)]
    lines = _products(fit, length, lambda x: (scaled_deviation(x, n, sums) / n).astype(np.float64))
    covariance = np.stack([lines[k] for k in range(length)]) / n
    covariance = (covariance + covariance.T) / 2
    values, components = refined_eigenvectors(covariance)
    found = Whitening(n, sums, values, components, float(np.trace(covariance)))
    lines = _products(fit, length, lambda x: found.apply(scaled_deviation(x, n, sums)))
    own = np.stack([lines[k] for k in range(len(found.good))]) / n - np.eye(len(found.good))
    return found, float(np.abs(own[np.ix_(found.good, found.good)]).max(initial=0.0))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of each row with a whole vector and each component."""
    rows = bound_batches(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")))
    schema = f"`{key}` {dict(rows.dtypes)['key']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = _length(rows, "vector")
    if length is None:
        return rows.sparkSession.createDataFrame([], schema)

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(_matrix(batch.column(0), length)[1]), pa.binary())], names=["packed"])

    fitted = fit_whitening(rows.select("vector").mapInArrow(packing, "packed binary"), length)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    found, error = fitted
    k = len(found.good)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _matrix(batch.column(1), length)
            scaled = scaled_deviation(x, found.n, found.sums)
            m = len(x)
            keys = batch.column(0).filter(pa.array(good)).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n, np.int64)),
                pa.array([v for v in _sum_of_squares(scaled) for _ in range(k)], pa.int64()),
                pa.array(found.apply(scaled).reshape(-1), mask=~np.tile(found.good, m)), pa.array(np.tile(found.explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op11_whitening(rows: DataFrame) -> DataFrame:
    """The first 16 whitened components of every embedding, under the contract of the query.

    The offset that the contract adds to every entry cancels in all columns, so vectors are kept without it.
    """
    return whiten(rows.select("vec_id", "embedding"))
