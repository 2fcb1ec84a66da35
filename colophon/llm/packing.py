"""Packing of token sequences by non-negative least squares.

Each document is cut into full windows and a rest.  The rests' lengths form a histogram of at most
``window`` bins.  All shallow combinations of lengths that fill a window, pairs and triples, are the
columns of a least-squares problem whose non-negative solution says how often each is used.  The
counts are rounded down to whole numbers that the histogram can serve.  Rests that no combination takes are packed
greedily: they fill one window after the other, and one that does not fit is cut there.

Solving depends on the window alone, not on the number of documents.  Rests get their place among
equals by distributed numbering, and meet the combinations through a small table of number ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colophon.llm.common import mapped, table
from colophon.llm.tokens import encoded
from colophon.operators.ranking import running_totals
from colophon.session import reuse

WINDOW = 1024
STEPS = 400


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of the given lengths that fill the window, as rows (a, b, c), a >= b >= c, 0 for none."""
    present = np.zeros(window + 1, bool)
    present[lengths[(lengths > 0) & (lengths < window)]] = True
    present[0] = True
    a = np.flatnonzero(present)
    first, second = (x.ravel() for x in np.meshgrid(a, a, indexing="ij"))
    third = window - first - second
    ok = (first >= second) & (second > 0) & (third >= 0) & (second >= third)
    first, second, third = first[ok], second[ok], third[ok]
    ok = present[third]
    return np.stack([first[ok], second[ok], third[ok]], 1)


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative counts whose use of each length is nearest to the histogram, by accelerated projected gradients."""
    n = len(combos)
    if not n:
        return np.zeros(0)
    wanted = histogram.astype(float).copy()
    wanted[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], weights=x, minlength=len(wanted)) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos[:, 0]] + r[combos[:, 1]] + np.where(combos[:, 2] > 0, r[combos[:, 2]], 0)

    v = np.ones(n)
    for _ in range(20):  # largest eigenvalue, for the step size
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - wanted) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def whole_counts(x: np.ndarray, histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeat counts near ``x`` that the histogram can serve, larger ones first."""
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    for up in (0.0, 0.999):  # rounded down for all, then up where lengths are left
        for k in np.argsort(-x, kind="stable"):
            want = int(np.floor(x[k] + up)) - int(out[k])
            if want <= 0:
                if x[k] <= 0:
                    break
                continue
            parts, need = np.unique(combos[k][combos[k] > 0], return_counts=True)
            take = min(want, int((left[parts] // need).min()))
            out[k] += take
            left[parts] -= take * need
    return out


def _ranges(combos: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from, to, first sequence, offset): which numbers among equals go where; and sequences used."""
    rows, given, sequence = [], {}, 0
    for combo, n in zip(combos.tolist(), counts.tolist()):
        if not n:
            continue
        offset = 0
        for length in combo:
            if length:
                begin = given.get(length, 0)
                rows.append((length, begin, begin + n, sequence, offset))
                given[length] = begin + n
                offset += length
        sequence += n
    return rows, sequence


def _crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """A row a document: ``doc_id``, ``n_tokens``, crc32 of each full window, and ids, crc32 and length of the rest."""
    rows = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 4 * window
        for batch, ids in encoded(batches, path, end_id):
            full = [[_crc(x[a : a + size]) for a in range(0, len(x) // size * size, size)] for x in ids]
            rest = [x[len(x) // size * size :] for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array([len(x) // 4 for x in rest], pa.int32()), pa.array([_crc(x) for x in rest], pa.int64()), pa.array(rest, pa.binary())],
                ["doc_id", "n_tokens", "full_crcs", "rest", "rest_crc", "rest_ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, work, f"doc_id {kind}, n_tokens bigint, full_crcs array<bigint>, rest int, rest_crc bigint, rest_ids binary")


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row a piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null texts count as empty and have the end id alone.  Repeated rows are documents of their own.
    Sequence ids count from 0: full windows, then combinations, then the greedy ones, of which only
    the last is not full.
    """
    spark = docs.sparkSession
    rows = reuse(tokenised(docs, path, window, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    whole = running_totals(rows.select("row", "doc_id", "n_tokens", "rest", "rest_crc", F.size("full_crcs").cast("bigint").alias("n_full"), F.lit(1).alias("one")), [("rest", "asc"), ("doc_id", "asc"), ("row", "asc")], {"place": "one", "before_full": "n_full"})
    whole = reuse(whole, "placed")
    histogram = np.zeros(window + 1, np.int64)
    for r in whole.groupBy("rest").agg(F.count("*").alias("n")).collect():  # at most ``window`` rows
        histogram[r["rest"]] = r["n"]
    n_full = int(whole.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0])
    lengths = np.flatnonzero(histogram)
    combos = combinations(lengths, window)
    counts = whole_counts(solve(histogram, combos), histogram, combos)
    ranges, used = _ranges(combos, counts)
    earlier = np.r_[0, np.cumsum(histogram)[:-1]]  # rests are numbered by length
    numbers = whole.filter("rest > 0").withColumn("number", F.col("place") - F.element_at(F.array(*[F.lit(int(n)) for n in earlier]), F.col("rest") + 1))
    # at most three rows a combination that fills the window: bounded by the window
    ranged = F.broadcast(spark.createDataFrame(ranges or [(-1, 0, 0, 0, 0)], "length int, low bigint, high bigint, first bigint, offset bigint"))
    met = numbers.join(ranged, (F.col("rest") == F.col("length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")), "left")
    met = reuse(met.select("row", "doc_id", "n_tokens", "rest", "rest_crc", (F.lit(n_full) + F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), "offset"), "met")
    begin = F.col("n_tokens") - F.col("rest")
    out = ["doc_id", F.col("start").cast("bigint"), F.col("length").cast("bigint"), F.col("ids_crc32").cast("bigint"), F.col("n_tokens").alias("doc_tokens"), F.col("sequence_id").cast("bigint"), F.col("offset").cast("bigint")]
    full = whole.filter("n_full > 0").select("row", "before_full").join(rows.select("row", "doc_id", "n_tokens", "full_crcs"), "row").select("doc_id", "n_tokens", "before_full", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * window).alias("start"), F.lit(window).alias("length"), "ids_crc32", "n_tokens", (F.col("before_full") + F.col("k")).alias("sequence_id"), F.lit(0).alias("offset"))
    combined = met.filter("sequence_id is not null").select("doc_id", begin.alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "n_tokens", "sequence_id", "offset")
    # the greedy part: windows filled end to end in order of length, long rests first
    left = running_totals(met.filter("sequence_id is null").select("row", "doc_id", "n_tokens", "rest"), [("rest", "desc"), ("doc_id", "asc"), ("row", "asc")], {"at": "rest"})
    bits = left.join(rows.select("row", "rest_ids"), "row").withColumn("window", F.explode(F.expr(f"sequence(at div {window}, (at + rest - 1) div {window})")))
    low, high = F.greatest(F.col("at"), F.col("window") * window), F.least(F.col("at") + F.col("rest"), (F.col("window") + 1) * window)
    bits = bits.withColumns({"low": low, "high": high})
    ids = F.substring(F.col("rest_ids"), ((F.col("low") - F.col("at")) * 4 + 1).cast("int"), ((F.col("high") - F.col("low")) * 4).cast("int"))
    greedy = bits.select("doc_id", (begin + F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"), F.crc32(ids).alias("ids_crc32"), "n_tokens", (F.col("window") + n_full + used).alias("sequence_id"), (F.col("low") - F.col("window") * window).alias("offset"))
    return full.select(*out).unionByName(combined.select(*out)).unionByName(greedy.select(*out))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Contract: the pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
