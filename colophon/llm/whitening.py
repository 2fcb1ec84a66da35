"""Whitening of embeddings by Jacobi-Davidson on their covariance.

The covariance is never formed.  Its product with a few vectors is one pass over the distinct
vectors, which are written once as blocks of whole numbers; each task centres its rows and adds up.
On the driver lie only matrices of the vectors' dimension and a few columns.

Each outer step does Rayleigh-Ritz in the subspace found so far.  Pairs whose residual is at double
precision are locked, from the largest eigenvalue down.  For the others the correction equations
``(I - QQ')(V - theta)(I - QQ') t = -r`` are solved by MINRES, all of them in step, so that an inner
step is one pass whatever the number of pairs; the solutions widen the subspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colophon.llm.common import mapped, table
from colophon.llm.vectors import added, dimension, floored, matrix
from colophon.session import reuse

SCALE = 256
#: distinct vectors a block
BLOCK = 4096
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


def _without(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The part of the columns of x that is orthogonal to an orthonormal basis."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def _orthonormal(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add x to the basis; columns that add nothing are left out."""
    out = np.zeros((len(x), 0))
    for k in range(x.shape[1]):
        column = x[:, k : k + 1]
        size = np.linalg.norm(column)
        if not size:
            continue
        column = _without(np.c_[basis, out], column / size)
        left = np.linalg.norm(column)
        if left > 1e-10:
            out = np.c_[out, _without(np.c_[basis, out], column / left)]
            out[:, -1] /= np.linalg.norm(out[:, -1])
    return out


def minres(product: Product, shifts: np.ndarray, fixed: np.ndarray, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Solutions of ``P (V - shift_j) P t_j = right_j`` with P away from ``fixed``, all columns in step, one product a step.

    The Lanczos vectors are kept and stay orthogonal, and the least residual over them comes from a
    small tridiagonal least-squares problem a column.
    """
    k = right.shape[1]
    start = np.linalg.norm(right, axis=0)
    vectors = [np.where(start > 0, right / np.where(start > 0, start, 1), 0)]
    diagonal, side = np.zeros((steps, k)), np.zeros((steps, k))
    solution = np.zeros_like(right)
    for n in range(steps):
        p = _without(fixed, product(vectors[-1]) - vectors[-1] * shifts)
        diagonal[n] = (vectors[-1] * p).sum(0)
        for _ in range(2):
            for v in vectors:
                p = p - v * (v * p).sum(0)
        side[n] = np.linalg.norm(p, axis=0)
        left = 0.0
        for j in np.flatnonzero(start > 0):
            t = np.zeros((n + 2, n + 1))
            t[np.arange(n + 1), np.arange(n + 1)] = diagonal[: n + 1, j]
            t[np.arange(1, n + 2), np.arange(n + 1)] = side[: n + 1, j]
            t[np.arange(n), np.arange(1, n + 1)] = side[:n, j]
            wanted = np.r_[start[j], np.zeros(n + 1)]
            y = np.linalg.lstsq(t, wanted, rcond=None)[0]
            left = max(left, float(np.linalg.norm(wanted - t @ y)) / start[j])
            solution[:, j] = sum(v[:, j] * x for v, x in zip(vectors, y))
        if left <= tolerance:
            break
        vectors.append(np.where(side[n] > EPS * start, p / np.where(side[n] > 0, side[n], 1), 0))
    return solution


def largest_pairs(product: Product, d: int, k: int, inner: int = 8, outer: int = 100, guards: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of a symmetric positive semidefinite matrix.

    Ends when all residuals are at rounding level: below 32 eps times the largest eigenvalue, or
    below 4096 eps times it and no longer falling.  A subspace that has grown to the whole space
    gives the pairs at once.  A few pairs more than asked for are improved too, so that close
    eigenvalues come in their order.
    """
    k = min(k, d)
    most = min(d, max(24 * k, 64))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _orthonormal(locked, np.random.default_rng(seed).standard_normal((d, min(d, k + 4))))
    image = product(space)
    last = np.full(k + guards, np.inf)
    for _ in range(outer):
        # Rayleigh-Ritz
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        active = min(k + guards - len(values), len(theta))
        want = min(k - len(values), len(theta))
        residual = _without(locked, image[:, :active] - space[:, :active] * theta[:active])
        size = np.linalg.norm(residual, axis=0)
        scale = max([0.0, *values[:1], *theta[:1]])
        done = (size <= 32 * EPS * scale) | (size <= 4096 * EPS * scale) & (size > last[:active] / 2) | (space.shape[1] + locked.shape[1] >= d)
        n = want if done[:want].all() else int(np.argmin(done[:want]))
        # the largest are locked first; the rest of the subspace is orthogonal to them
        locked, values = np.c_[locked, space[:, :n]], np.r_[values, theta[:n]]
        space, image, theta, residual, size = space[:, n:], image[:, n:], theta[n:], residual[:, n:], size[n:]
        if len(values) == k or not space.shape[1]:
            return values, locked
        last = np.r_[size, np.full(k + guards, np.inf)][: k + guards]
        active -= n
        if space.shape[1] + 2 * active > most - locked.shape[1] and most < d:
            space, image = space[:, : max(active, most // 3)], image[:, : max(active, most // 3)]
        fixed = np.c_[locked, space[:, :active]]
        correction = minres(product, theta[:active], fixed, -residual, inner, 1e-3)
        new = _orthonormal(np.c_[locked, space], np.c_[correction, residual])
        if not new.shape[1]:
            # nothing but rounding is left to add
            return np.r_[values, theta[: k - len(values)]], np.c_[locked, space[:, : k - len(values)]]
        space, image = np.c_[space, new], np.c_[image, product(new)]
    raise ArithmeticError("the residuals have not reached double precision")


def quantised(df: DataFrame, column: str, d: int, *keep: str) -> DataFrame:
    """``keep`` columns and ``x``, floor(256 * entry) of each entry as longs in binary form, of usable rows."""
    rows = df.select(*keep, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(column), d)
            x = floored(values, SCALE).astype("<i8")
            data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 8 * d).astype(np.int32)), pa.py_buffer(x)])
            kept = [batch.column(c).take(pa.array(at)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, data], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(rows, work, f"{kinds}, x binary" if keep else "x binary")


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """Whole-number rows of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i8")[offsets[0] // 8 : offsets[-1] // 8].reshape(-1, d) if len(column) else np.zeros((0, d), np.int64)


def fit_blocks(df: DataFrame, column: str, d: int) -> DataFrame:
    """Each distinct whole-number vector once, ``BLOCK`` of them a row: ``rows`` in binary form."""
    distinct = quantised(df, column, d).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"), d)
            for a in range(0, len(x), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x[a : a + BLOCK].tobytes()], pa.binary())], ["rows"])

    return reuse(mapped(distinct, work, "rows binary"), "vectors")


class Covariance:
    """Sums and products over blocks of distinct vectors."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d = blocks, d

        def sums(x: np.ndarray) -> list[np.ndarray]:
            # two halves, so that no sum leaves the longs
            return [np.array([len(x)]), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.abs(x).max(0, initial=0) if len(x) else np.zeros(d, np.int64)]

        def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
            low = a[2] + b[2]
            return [a[0] + b[0], a[1] + b[1] + (low >> 32), low & 0xFFFFFFFF, np.maximum(a[3], b[3])]

        found = self._over(sums, merge)
        self.n = int(found[0][0]) if found else 0
        #: exact sums, as whole numbers of any size
        self.sums = [(int(h) << 32) + int(low) for h, low in zip(found[1], found[2])] if found else [0] * d
        self.largest = int(max(found[3].max(initial=0), 0)) if found else 0
        self.mean = np.array([s / max(self.n, 1) for s in self.sums])

    def _over(self, work: Callable[[np.ndarray], list[np.ndarray]], merge=None) -> list[np.ndarray] | None:
        d = self.d

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for data in batch.column("rows"):
                    yield work(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d))

        return added(self.blocks, partial, merge)

    def trace(self) -> float:
        mean = self.mean
        found = self._over(lambda x: [((x - mean) ** 2).sum(0)])
        return float(found[0].sum()) / self.n if found else 0.0

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times vectors: rows are centred, then multiplied."""
        mean = self.mean

        def work(x: np.ndarray) -> list[np.ndarray]:
            centred = x - mean
            return [centred.T @ (centred @ vectors)]

        return self._over(work)[0] / self.n

    def identity_error(self, turn: np.ndarray) -> float:
        """Largest entry of the covariance of whitened rows, less the identity; turn has eigenvectors over root eigenvalues."""
        mean = self.mean
        centre = self._over(lambda x: [((x - mean) @ turn).sum(0)])[0] / self.n

        def work(x: np.ndarray) -> list[np.ndarray]:
            w = (x - mean) @ turn - centre
            return [w.T @ w]

        return float(np.abs(self._over(work)[0] / self.n - np.eye(turn.shape[1])).max())


def whitened(df: DataFrame, k: int = 4, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, holds a null or a non-finite entry, or has another length than most
    have none.  Repeated rows and rows without an id have rows of their own; other columns are not
    read.  Components whose eigenvalue is zero up to rounding are left out, so vectors that are all
    alike have no rows.  A deviation beyond the longs is null.
    """
    spark = df.sparkSession
    schema = f"{key} {df.schema[key].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    d = dimension(df, column)
    if not d:
        return spark.createDataFrame([], schema)
    fit = Covariance(fit_blocks(df, column, d), d)
    trace = fit.trace()
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, vectors = largest_pairs(fit.product, d, k)
    real = values > values[0] * EPS * max(d, 16)
    values, vectors = values[real], vectors[:, real]
    turn = vectors / np.sqrt(values)
    error, explained = fit.identity_error(turn), values / trace
    n, sums, mean, m = fit.n, fit.sums, fit.mean, len(values)
    # the sum of squares stays within the longs if this does
    bound = d * (n * fit.largest + max(abs(s) for s in sums)) ** 2

    def deviations(x: np.ndarray) -> pa.Array:
        if bound < 2**63:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1))
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"), d)
            if not len(x):
                continue
            rows = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(rows), pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), n)), deviations(x).take(rows), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return mapped(quantised(df, column, d, key), work, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract: the first four whitened components of every usable embedding."""
    return whitened(table(spark, sf_dir, "embeddings"))
