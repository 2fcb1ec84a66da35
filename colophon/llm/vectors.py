"""Vectors of a table as matrices inside tasks, and sums over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colophon.llm.common import mapped

#: tasks that add up what the tasks of a scan have found; as many rows reach the driver
ADDERS = 8


def dimension(df: DataFrame, column: str) -> int:
    """The commonest length of vectors without null or non-finite entries, the least of several; 0 if there are none."""
    finite = F.forall(column, lambda x: F.coalesce(x - x == 0, F.lit(False)))
    rows = df.filter(finite).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    top = rows.filter("d > 0").orderBy(F.desc("n"), "d").first()
    return int(top["d"]) if top else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``d`` finite numbers, and these rows as doubles."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == d)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d)
    finite = np.isfinite(values).all(1)
    return rows[finite], values[finite]


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as longs, those out of range at the nearest end of it."""
    out = np.floor(values * scale)
    inside = np.clip(out, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(out >= 2.0**63, np.int64(2**63 - 1), inside)


def added(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], merge: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]] | None = None) -> list[np.ndarray] | None:
    """The sum of arrays that every task of ``df`` gives, None if none does.

    ``partial`` yields lists of arrays of doubles or longs, alike in number and shape.  The arrays of
    a task are one row; ``ADDERS`` tasks add these up in order of their tasks, and the driver adds
    what they have.  Nothing grows with the rows.
    """
    merge = merge or (lambda a, b: [x + y for x, y in zip(a, b)])

    def packed(arrays: list[np.ndarray]) -> tuple[bytes, list[int], str]:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), [n for x in arrays for n in (x.ndim, *x.shape)], "".join(x.dtype.kind for x in arrays)

    def unpacked(data: bytes, shapes: list[int], kinds: str) -> list[np.ndarray]:
        out, at, k = [], 0, 0
        for kind in kinds:
            shape = shapes[k + 1 : k + 1 + shapes[k]]
            k += 1 + shapes[k]
            n = int(np.prod(shape))
            out.append(np.frombuffer(data, np.float64 if kind == "f" else np.int64, n, at).reshape(shape))
            at += 8 * n
        return out

    def batch(part: int, total: list[np.ndarray]) -> pa.RecordBatch:
        data, shapes, kinds = packed(total)
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([data], pa.binary()), pa.array([shapes], pa.list_(pa.int64())), pa.array([kinds])], ["part", "data", "shapes", "kinds"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for found in partial(batches):
            total = found if total is None else merge(total, found)
        if total is not None:
            yield batch(TaskContext.get().partitionId(), total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            for data, shapes, kinds in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3))):
                found = unpacked(data, shapes, kinds)
                total = found if total is None else merge(total, found)
        if total is not None:
            yield batch(TaskContext.get().partitionId(), total)

    schema = "part bigint, data binary, shapes array<bigint>, kinds string"
    parts = mapped(df, first, schema).repartition(ADDERS, "part").sortWithinPartitions("part")
    total = None
    for r in sorted(mapped(parts, again, schema).collect(), key=lambda r: r["part"]):
        found = unpacked(bytes(r["data"]), r["shapes"], r["kinds"])
        total = found if total is None else merge(total, found)
    return total
