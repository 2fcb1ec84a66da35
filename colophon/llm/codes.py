"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

The nearest entry is found by slices and intersections.  For every dimension of a part the entries
are sorted by that coordinate, and the mask of the first p of them, a bit an entry in uint64 words,
is kept for each p.  A probe, the entry nearest in one coordinate, gives a radius within which the
nearest must lie.  In each dimension the entries from ``x - radius`` to ``x + radius`` are a range of
the sorted ones, whose mask is the difference of two prefix masks; the masks of all dimensions are
ANDed.  No entry outside can be nearest, so exact distances of the candidates decide.

Codebooks are fitted to all rows: the rows' tasks add up the parts of each entry, and only these sums,
256 entries of a vector's dimension, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colophon.llm.common import mapped, table
from colophon.llm.vectors import added, dimension, floored, matrix
from colophon.session import reuse

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: coordinates that probes come from
PROBES = 4
#: rows compared at once
ROWS = 2048
#: labels met by the rows are dealt so often, against labels that most rows have
DEALT = 16


class Codebook:
    """Entries of one part with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, d = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, 0)
        words = -(-n // 64)
        self.masks = np.zeros((d, n + 1, words), np.uint64)
        for j in range(d):
            for p, e in enumerate(self.order[:, j].tolist()):
                self.masks[j, p + 1] = self.masks[j, p]
                self.masks[j, p + 1, e // 64] |= np.uint64(1 << e % 64)
        spread = entries.max(0).astype(float) - entries.min(0)
        self.probes = np.argsort(-spread, kind="stable")[:PROBES]
        #: beyond this, squared distances would leave what doubles and longs hold exactly
        self.safe = isqrt(2**50 // d) // 2
        self.small = int(np.abs(entries.astype(float)).max()) <= self.safe

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower of equal ones, and the squared distance."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        small = np.abs(x.astype(float)).max(1) <= self.safe if self.small else np.zeros(len(x), bool)
        for rows in (np.flatnonzero(small), np.flatnonzero(~small)):
            for a in range(0, len(rows), ROWS):
                some = rows[a : a + ROWS]
                code[some], error[some] = self._nearest(x[some]) if small[some[0]] else self._exact(x[some])
        return code, error

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within the radius of each row in every coordinate."""
        out = None
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask = self.masks[j].take(high, 0) & ~self.masks[j].take(low, 0)
            out = mask if out is None else out & mask
        return out

    def _probe(self, x: np.ndarray) -> np.ndarray:
        """The least squared distance to the entries that are next in one coordinate."""
        best = None
        for j in self.probes:
            at = np.minimum(np.searchsorted(self.sorted[:, j], x[:, j]), len(self.entries) - 1)
            found = ((x - self.entries.take(self.order[:, j].take(at), 0)) ** 2).sum(1)
            best = found if best is None else np.minimum(best, found)
        return best

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = np.floor(np.sqrt(self._probe(x).astype(float))).astype(np.int64) + 1
        masks = self.candidates(x, radius)
        # entries that are candidates of some row; rows and entries are whole numbers that doubles hold
        union = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(masks, 0).view(np.uint8), bitorder="little")[: len(self.entries)])
        chosen, rows = self.entries.take(union, 0).astype(float), x.astype(float)
        apart = (rows**2).sum(1)[:, None] - 2 * rows @ chosen.T + (chosen**2).sum(1)
        bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little").take(union, 1)
        apart[bits == 0] = np.inf
        at = apart.argmin(1)
        return union.take(at), apart[np.arange(len(x)), at].astype(np.int64)

    def _exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for numbers of any size; distances beyond the longs are given as the largest long."""
        entries, code, error = self.entries.tolist(), [], []
        for row in x.tolist():
            found = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in entries]
            error.append(min(found))
            code.append(found.index(error[-1]))
        return np.array(code), np.array([min(e, 2**63 - 1) for e in error], np.int64)


def _wide(d: int) -> int:
    """The dimension with zeros appended until the parts are equal."""
    return -(-d // PARTS) * PARTS


def _floors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and their whole numbers, by part."""
    at, values = matrix(column, d)
    x = np.zeros((len(at), _wide(d)), np.int64)
    x[:, :d] = floored(values, SCALE)
    return at, x.reshape(len(at), PARTS, -1)


def start_books(df: DataFrame, column: str, key: str, d: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the usable vectors of least id, ascending; null ids last, equal ids by vector."""
    finite = F.forall(column, lambda x: F.coalesce(x - x == 0, F.lit(False)))
    rows = df.filter(finite & (F.size(column) == d)).select(key, column)
    found = rows.orderBy(F.col(key).asc_nulls_last(), column).limit(entries).collect()
    x = np.zeros((len(found), _wide(d)), np.int64)
    x[:, :d] = floored(np.array([r[column] for r in found], float), SCALE)
    return np.ascontiguousarray(x.reshape(len(found), PARTS, -1).swapaxes(0, 1))


def improved(df: DataFrame, column: str, books: np.ndarray, d: int) -> np.ndarray:
    """One round over all rows: entries become the floor of the mean of their parts, unused ones stay."""
    n, width = books.shape[1:]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        indexes = [Codebook(b) for b in books]
        for batch in batches:
            _, x = _floors(batch.column(column), d)
            if not len(x):
                continue
            counts = np.zeros((PARTS, n), np.int64)
            high, low = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n, width), np.int64)
            for p, index in enumerate(indexes):
                code, _ = index.nearest(x[:, p])
                counts[p] = np.bincount(code, minlength=n)
                order = np.argsort(code, kind="stable")
                used = np.flatnonzero(counts[p])
                begins = (np.cumsum(counts[p]) - counts[p])[used]
                mine = x[order, p]
                # two halves, so that no sum leaves the longs
                high[p, used] = np.add.reduceat(mine >> 32, begins, axis=0)
                low[p, used] = np.add.reduceat(mine & 0xFFFFFFFF, begins, axis=0)
            yield [counts, high + (low >> 32), low & 0xFFFFFFFF]

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        low = a[2] + b[2]
        return [a[0] + b[0], a[1] + b[1] + (low >> 32), low & 0xFFFFFFFF]

    found = added(df.select(column), partial, merge)
    counts, high, low = found
    out = books.copy()
    for p, e in np.argwhere(counts > 0).tolist():
        out[p, e] = [((int(h) << 32) + int(v)) // int(counts[p, e]) for h, v in zip(high[p, e], low[p, e])]
    return out


def fitted(df: DataFrame, column: str, key: str, d: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after all rounds: by part, entry and place in the part."""
    books = start_books(df, column, key, d)
    for _ in range(rounds):
        books = improved(df, column, books, d)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all whole numbers of the codebooks, in decimal, with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(df: DataFrame, books: np.ndarray, d: int, column: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part) and ``error`` of every usable row."""
    rows = df.select(key, label, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Codebook(b) for b in books]
        for batch in batches:
            at, x = _floors(batch.column(column), d)
            found = [index.nearest(x[:, p]) for p, index in enumerate(indexes)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
            errors = np.stack([f[1] for f in found], 1)
            total = errors.sum(1) if errors.max(initial=0) < 2**60 else np.array([min(sum(e), 2**63 - 1) for e in errors.tolist()], np.int64)
            picked = pa.array(at)
            width = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(picked), batch.column(label).take(picked), pa.array([codes[a : a + width] for a in range(0, len(codes), width)], pa.string()), pa.array(total, pa.int64())],
                [key, label, "code", "error"],
            )

    kind = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}
    return mapped(rows, work, f"`{key}` {kind[key]}, `{label}` {kind[label]}, code string, error bigint")


def compressed(df: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every usable row.

    Rows whose vector is null, holds a null or a non-finite entry, or has another length than most
    are left out.  Repeated rows and rows without an id have rows of their own; other columns are not
    read.  With fewer than 256 usable rows the codebooks have as many entries.  A dimension that
    four does not divide gets zeros at its end.  Errors beyond the longs are given as the largest
    long, and their sum by label is null.
    """
    spark = df.sparkSession
    d = dimension(df, column)
    kind = df.schema[key].dataType.simpleString()
    if not d:
        return spark.createDataFrame([], f"`{key}` {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = fitted(df, column, key, d)
    rows = reuse(coded(df, books, d, column, key, label), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = reuse(rows.groupBy(label).agg(total.alias("label_error")).withColumn("label_error", F.expr("try_cast(label_error as bigint)")), "labels")
    # a label may hold a third of all rows: rows are dealt, label sums are one row a label and deal
    dealt = sums.select(F.col(label).alias("_label"), "label_error", F.explode(F.array(*[F.lit(k) for k in range(DEALT)])).alias("_deal"))
    mine = rows.withColumn("_deal", F.pmod(F.xxhash64("code", key), F.lit(DEALT)).cast("int"))
    met = mine.join(dealt, mine[label].eqNullSafe(dealt["_label"]) & (mine["_deal"] == dealt["_deal"]))
    return met.select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract: codes and errors of every usable embedding."""
    return compressed(table(spark, sf_dir, "embeddings"))
