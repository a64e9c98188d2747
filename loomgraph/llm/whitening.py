"""Whitening of embeddings: exact distributed moments, then float32 eigenvectors corrected in higher precision by Ogita-Aishima
iterations of matrix products, where eigenvalues that lie too close together are told apart by sub-solves in their own space.

Entries become integers x. Sums of x are exact; moments are taken of x less an integer near the mean, so every product and sum is
an integer that a double holds (up to 2^53), whatever the partitions are. The driver sees d * d numbers for d dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of this size or more, whose integers would not be exact, count as non-finite.
TOO_LARGE = 2.0**39
#: A component whose share of the variance is at most this is no direction of the data but rounding.
NO_VARIANCE = 1e-13
#: Rows that one matrix product takes.
ROWS = 1 << 13


def sound(vector: Column, dimensions: int | None = None) -> Column:
    """Whether a vector is given and all its entries are finite, and, where ``dimensions`` is set, as many."""
    entries = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < TOO_LARGE))  # not a number is larger than all
    return F.coalesce(vector.isNotNull() & entries & (F.lit(True) if dimensions is None else F.size(vector) == dimensions), F.lit(False))


def _matrices(column: pa.Array, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    """(from, x) of runs of rows: the entries as integers."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    for low in range(0, len(flat), ROWS):
        yield low, np.floor(SCALE * flat[low : low + ROWS]).astype(np.int64) + OFFSET


def sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """(rows, sum of x for each dimension), exact. ``vectors``: one column of sound vectors."""
    name = vectors.columns[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimensions
        for batch in batches:
            for _, x in _matrices(batch.column(name), dimensions):
                n, total = n + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "v"])

    found = {r["i"]: int(r["v"]) for r in vectors.mapInArrow(work, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimensions)]


def _products(vectors: DataFrame, dimensions: int, size: int, rows_of) -> np.ndarray:
    """The sum over all vectors of r r^T, where ``rows_of`` makes rows r of length ``size`` of the integers x. One row for each cell and task is dealt."""
    name = vectors.columns[0]
    a, b = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _matrices(batch.column(name), dimensions):
                r = rows_of(x)
                total += r.T @ r
        yield pa.RecordBatch.from_arrays([pa.array(a * size + b, pa.int64()), pa.array(total[a, b])], ["i", "v"])

    found = vectors.mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    at = found["i"].to_numpy()
    out[at // size, at % size] = out[at % size, at // size] = found["v"].to_numpy()
    return out


# --- eigenvectors


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more sorted values of which each lies within ``near`` of the next."""
    order = np.argsort(-values)
    apart = np.flatnonzero(-np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, apart) if len(run) > 1]


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima correction of approximate eigenvectors x of a: (x, values, the largest correction, how near values are too close)."""
    r = np.eye(x.shape[1], dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # a difference of rounding over a small gap would cost orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    near = float(2 * (np.sqrt((off**2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum())))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= near
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, float(np.abs(e).max()), near


def eigenvectors(matrix: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix by falling value, to double precision.

    The first vectors are float32's. Corrections square the error; they run in extended precision, as the residuals of doubles would hide in rounding.
    Values nearer to each other than the residual can't be told apart by them: their common space is right, and the matrix in that space, less their
    mean, is solved by itself, where they are as far apart as its precision allows. Equal values keep any orthonormal vectors of their space.
    """
    size = len(matrix)
    a = np.asarray(matrix, np.longdouble)
    scale = np.abs(a).max() if size else 0
    if not scale:
        return np.zeros(size), np.eye(size)
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    least, since = np.inf, 0
    for _ in range(rounds):
        x, values, change, near = _corrected(a, x)
        for run in _clusters(values, near):
            own = x[:, run]
            middle = values[run].mean()
            inner = own.T @ (a @ own - middle * own)
            size_in = np.abs(inner).max()
            if size_in > 0:
                x[:, run] = own @ np.linalg.eigh(np.asarray((inner + inner.T) / (2 * size_in), np.float64))[1].astype(np.longdouble)
        # far below double precision, or no better for some rounds: what is left is rounding
        since = since + 1 if change >= least / 2 else 0
        least = min(least, change)
        if change < 1e-18 or since >= 4:
            break
    x = x @ (1.5 * np.eye(size) - 0.5 * (x.T @ x))
    x = x / np.sqrt((x**2).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x) * scale
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


# --- the operator


@dataclass(frozen=True)
class Whitening:
    """x whitened is (x - shift - rest) @ axes; ``values``: variances of the components. Axes of components without variance are NaN."""

    n: int
    sums: list[int]
    shift: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) - self.rest) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 for each row, exact; None where it exceeds a long."""
        d, left = x - self.shift, np.array([s - self.n * int(m) for s, m in zip(self.sums, self.shift, strict=True)], np.int64)
        most = float(self.n) * float(np.abs(d).max(initial=0)) + float(np.abs(left).max(initial=0))
        if most**2 * d.shape[1] < 2.0**62:
            y = self.n * d - left
            return (y * y).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, left, strict=True)) for row in d]
        return [v if v < 2**63 else None for v in exact]


def fit(vectors: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all sound ``vectors`` (one column); None without any."""
    n, total = sums(vectors, dimensions)
    if not n:
        return None
    shift = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    left = [s - n * int(m) for s, m in zip(total, shift, strict=True)]  # sums of x - shift
    moments = _products(vectors, dimensions, dimensions, lambda x: (x - shift).astype(np.float64))
    rest = np.array(left, np.longdouble) / n
    covariance = np.asarray(moments, np.longdouble) / n - np.outer(rest, rest)
    values, axes = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    kept = min(components, dimensions)
    some = values[:kept] > NO_VARIANCE * max(trace, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(some, axes[:, :kept] / np.sqrt(np.where(some, values[:kept], 1)), np.nan)
        explained = np.where(some, values[:kept] / trace, 0.0) if trace > 0 else np.zeros(kept)
    return Whitening(n, total, shift, rest.astype(np.float64), scaled, values[:kept], explained)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured over all of them; components without variance are left out."""
    some = ~np.isnan(model.axes).any(axis=0)
    k = int(some.sum())
    if not k:
        return 0.0
    # a last entry of 1 gives their sums as well
    found = _products(vectors, len(model.sums), k + 1, lambda x: np.column_stack([model.whitened(x)[:, some], np.ones(len(x))]))
    mean = found[:k, k] / model.n
    return float(np.abs(found[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row with a sound vector and each component.

    Rows drop out whose vector is null, holds a null, is shorter than the longest one (its missing entries are null) or holds an entry that is not finite or
    2^39 or more in size. There are as many components as dimensions, at most ``components``. Where data have no variance along a component
    (fewer rows or directions than components) ``whitened`` is null and ``explained`` 0. Ids may be null or repeat, each row is one of the fit list; a deviation
    beyond a long is null. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    given = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    dimensions = given.agg(F.max(F.size("v"))).collect()[0][0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if dimensions < 1:
        return given.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])])
    fine = given.filter(sound(F.col("v"), dimensions))
    vectors = fine.select("v")
    model = fit(vectors, dimensions, components)
    if model is None:
        return given.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])])
    error, k = identity_error(vectors, model), len(model.values)
    shared = given.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, x in _matrices(batch.column("v"), dimensions):
                rows = len(x)
                w, each = m.whitened(x).ravel(), pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id")[low : low + rows].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n, np.int64)),
                        pa.array(m.deviations(x), pa.int64()).take(each), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(m.explained, rows)), pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fine.mapInArrow(work, schema)
