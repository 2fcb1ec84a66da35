"""Packing of whole documents by best fit and a swap-based local search.

A document longer than a window is cut into full windows, its first piece takes what is left over,
and all first pieces are packed uncut.  Pieces of one length are alike, so bins are kept as kinds: a
kind is how often each length lies in a bin, and how many bins are like that.  Best fit decreasing
fills the bins length by length.  Then underfull bins exchange documents: the fullest takes one or
gives one or two for one or two of a bin that is less full, whatever fills it most, and so raises
the sum of the squared fills; bins whose last document goes vanish.  Moves between kinds are made
for as many pairs of bins as there are, so the search depends on the window, not on the corpus.

Only the histogram of lengths, ``window`` numbers, reaches the driver.  Documents are numbered within
their length by partition, and meet the bins through a table of number ranges.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from colophon.llm.common import mapped, table
from colophon.llm.tokens import encoded
from colophon.session import reuse

WINDOW = 1024
#: the search ends after so many moves a length of the window, if it has not ended by itself
MOVES = 20

Kind = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _changed(kind: Kind, less: tuple[int, ...], more: tuple[int, ...]) -> Kind:
    held = dict(kind)
    for n in less:
        held[n] -= 1
    for n in more:
        held[n] = held.get(n, 0) + 1
    return tuple(sorted(((n, k) for n, k in held.items() if k), reverse=True))


def fill(kind: Kind) -> int:
    return sum(n * k for n, k in kind)


def best_fit(histogram: np.ndarray) -> dict[Kind, int]:
    """Bins by best fit decreasing: kinds and how many bins are of each.

    A length meets the kinds with the least room that it fits in, and fills one bin after the other.
    It splits at most one kind in three and opens two, so there are at most four kinds a length.
    """
    window = len(histogram) - 1
    rooms: dict[int, dict[Kind, int]] = defaultdict(dict)
    for length in range(window, 0, -1):
        left = int(histogram[length])
        for room in sorted(r for r, kinds in rooms.items() if r >= length and kinds) + [window]:
            kinds = rooms.pop(room, {}) if room < window else {(): left}
            for kind, bins in kinds.items():
                each = room // length
                full = min(bins, left // each)
                rest = min(left - full * each, each if full < bins else 0)
                left -= full * each + rest
                for n, many in ((each, full), (rest, 1 if rest else 0), (0, bins - full - (1 if rest else 0))):
                    if many and (n or kind):
                        new = tuple(sorted((*kind, (length, n)), reverse=True)) if n else kind
                        at = rooms[room - n * length]
                        at[new] = at.get(new, 0) + many
            if not left:
                break
    return {kind: bins for kinds in rooms.values() for kind, bins in kinds.items()}


class _Search:
    """Underfull kinds, with the lengths and sums of two lengths that each could give away."""

    def __init__(self, kinds: dict[Kind, int], window: int):
        self.window = window
        self.full: dict[Kind, int] = {k: n for k, n in kinds.items() if fill(k) == window}
        self.slots: dict[Kind, int] = {}
        self.kinds: list[Kind | None] = []
        self.bins: list[int] = []
        self.free: list[int] = []
        self.fills = np.zeros(0, np.int64)
        self.gives = np.zeros((2, 0, window + 1), bool)
        #: how many kinds that may still give have a sum, by number of documents
        self.count = np.zeros((2, window + 1), np.int64)
        self.giving = np.zeros(0, bool)
        for kind, n in kinds.items():
            if fill(kind) < window:
                self.add(kind, n)

    @staticmethod
    def sums(kind: Kind) -> dict[int, list[tuple[int, ...]]]:
        """One and two documents of a bin."""
        ones = [(n,) for n, _ in kind]
        twos = [(a, b) for i, (a, k) in enumerate(kind) for b, _ in kind[i if k > 1 else i + 1 :]]
        return {1: ones, 2: twos}

    def add(self, kind: Kind, bins: int) -> None:
        if not bins or not kind:
            return
        if fill(kind) == self.window:
            self.full[kind] = self.full.get(kind, 0) + bins
            return
        if kind in self.slots:
            self.bins[self.slots[kind]] += bins
            return
        if not self.free:
            more = max(64, len(self.kinds))
            self.free = list(range(len(self.kinds) + more - 1, len(self.kinds) - 1, -1))
            self.kinds += [None] * more
            self.bins += [0] * more
            self.fills = np.r_[self.fills, np.zeros(more, np.int64)]
            self.giving = np.r_[self.giving, np.zeros(more, bool)]
            self.gives = np.concatenate([self.gives, np.zeros((2, more, self.window + 1), bool)], 1)
        slot = self.free.pop()
        self.slots[kind], self.kinds[slot], self.bins[slot], self.fills[slot] = slot, kind, bins, fill(kind)
        self.gives[:, slot] = False
        for k, found in self.sums(kind).items():
            self.gives[k - 1, slot, [sum(x) for x in found]] = True
        self.give(slot, True)

    def give(self, slot: int, yes: bool) -> None:
        if self.giving[slot] != yes:
            self.giving[slot] = yes
            self.count += self.gives[:, slot] if yes else -self.gives[:, slot].astype(np.int64)

    def take(self, slot: int, bins: int) -> None:
        self.bins[slot] -= bins
        if not self.bins[slot]:
            self.give(slot, False)
            del self.slots[self.kinds[slot]]
            self.kinds[slot] = None
            self.free.append(slot)

    def improve(self, slot: int) -> list[Kind]:
        """Fills the bins of a kind as far as one move goes.  Returns the kinds that came about, none if no move does."""
        kind, bins = self.kinds[slot], self.bins[slot]
        gap = self.window - int(self.fills[slot])
        if bins == 1:
            self.give(slot, False)
        numbers = np.arange(self.window + 1)
        # the largest sum up to each number that some bin can give, in one or in two documents
        most = [np.maximum.accumulate(np.where(c > 0, numbers, 0)) for c in self.count]
        own = self.sums(kind)
        best: tuple[int, tuple[int, ...], int] = (0, (), 0)
        for out, into in (((),), (1,)), (own[1], (1, 2)), (own[2], (1,)):
            if not len(out):
                continue
            given = np.array([sum(x) for x in out])
            for n in into:
                gain = most[n - 1].take(np.minimum(given + gap, self.window)) - given
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (int(gain[at]), tuple(out[at]), n)
        gain, out, n = best
        if not gain:
            return []
        wanted = gain + sum(out)
        givers = np.flatnonzero(self.gives[n - 1, :, wanted] & self.giving)
        other = int(givers[self.fills.take(givers).argmin()])  # the least full bin gives
        from_kind = self.kinds[other]
        into = next(x for x in self.sums(from_kind)[n] if sum(x) == wanted)
        many = bins // 2 if other == slot else min(bins, self.bins[other])
        new = [_changed(kind, out, into), _changed(from_kind, into, out)]
        self.take(slot, many)
        self.take(other, many)
        for k in new:
            self.add(k, many)
        return [k for k in (*new, kind, from_kind) if k in self.slots]


def exchanged(kinds: dict[Kind, int], window: int, moves: int = MOVES) -> dict[Kind, int]:
    """The bins after moves, one-for-one and two-for-one exchanges that raise the sum of squared fills."""
    search = _Search(kinds, window)
    left, moved = moves * window, True
    while moved and left > 0:
        moved = False
        for slot in search.slots.values():
            search.give(slot, True)
        queue = [(-fill(k), k) for k in search.slots]
        heapq.heapify(queue)
        # the fullest first; one that finds nothing gives nothing either to those that are less full
        while queue and left > 0:
            _, kind = heapq.heappop(queue)
            slot = search.slots.get(kind)
            if slot is None or (not search.giving[slot] and search.bins[slot] > 1):
                continue
            new = search.improve(slot)
            if new:
                left, moved = left - 1, True
                for k in new:
                    search.give(search.slots[k], True)
                    heapq.heappush(queue, (-fill(k), k))
            else:
                search.give(slot, False)
    out = dict(search.full)
    for kind, slot in search.slots.items():
        out[kind] = out.get(kind, 0) + search.bins[slot]
    return out


def solve(histogram: np.ndarray) -> dict[Kind, int]:
    return exchanged(best_fit(histogram), len(histogram) - 1)


def _ranges(kinds: dict[Kind, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, bins, first bin, offset): which numbers of a length lie where.

    The number ``from + slot * bins + k`` lies in bin ``first bin + k`` at ``offset + slot * length``.
    """
    rows, given, first = [], defaultdict(int), 0
    for kind, bins in sorted(kinds.items(), reverse=True):
        offset = 0
        for length, times in kind:
            rows.append((length, given[length], given[length] + times * bins, bins, first, offset))
            given[length] += times * bins
            offset += times * length
        first += bins
    return rows


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """A row a document: ``doc_id``, ``first`` (length of its first piece), ``first_crc``, ``full_crcs`` of the
    pieces after it, ``part``, ``place`` (number among equal lengths of the partition), ``full`` (full pieces of the
    partition before it)."""
    rows = docs.select("doc_id", "text")
    size = 4 * window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, before = np.zeros(window + 1, np.int64), 0
        for batch, ids in encoded(batches, path, end_id):
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            first = (lengths - 1) % window + 1
            crcs = [zlib.crc32(x[: 4 * n]) for x, n in zip(ids, first.tolist())]
            full = [[zlib.crc32(x[a : a + size]) for a in range(4 * n, len(x), size)] for x, n in zip(ids, first.tolist())]
            order = np.argsort(first, kind="stable")
            equal = first[order]
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids)) - np.searchsorted(equal, equal) + seen.take(equal)
            seen += np.bincount(first, minlength=window + 1)
            many = np.fromiter(map(len, full), np.int64, len(full))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(first, pa.int32()), pa.array(crcs, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(np.full(len(ids), part), pa.int64()), pa.array(place), pa.array(before + np.cumsum(many) - many)],
                ["doc_id", "first", "first_crc", "full_crcs", "part", "place", "full"],
            )
            before += int(many.sum())

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, work, f"doc_id {kind}, first int, first_crc bigint, full_crcs array<bigint>, part bigint, place bigint, full bigint")


def packed_whole(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null texts count as empty and have the end id alone.  Repeated rows, and rows without an id, are
    documents of their own; other columns are not read.  Full pieces have negative sequence ids, bins
    count from 0.
    """
    spark = docs.sparkSession
    rows = reuse(tokenised(docs, path, window, end_id), "tokens")
    counts = reuse(rows.groupBy("part", "first").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("first").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r["first"]] = r["n"]
    earlier = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # bounded by the window: at most four kinds a length, each of at most sqrt(2 * window) lengths
    ranges = F.broadcast(spark.createDataFrame(_ranges(solve(histogram)) or [(-1, 0, 0, 1, 0, 0)], "first int, low bigint, high bigint, bins bigint, bin bigint, begin bigint"))
    slim = rows.select("doc_id", "first", "first_crc", "part", "place").join(before, ["part", "first"])
    number = F.col("place") + F.col("before")
    met = slim.join(ranges, (slim["first"] == ranges["first"]) & (number >= F.col("low")) & (number < F.col("high")))
    at = number - F.col("low")
    first = met.select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), slim["first"].cast("bigint").alias("length"), F.col("first_crc").alias("ids_crc32"),
        (F.col("bin") + at % F.col("bins")).alias("sequence_id"), (F.col("begin") + F.expr("1").cast("bigint") * F.floor(at / F.col("bins")) * slim["first"]).cast("bigint").alias("offset"),
    )
    full = rows.filter(F.size("full_crcs") > 0).select("doc_id", "first", "part", "full", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("k") + 1).alias("piece"), (F.col("first") + F.col("k").cast("bigint") * window).alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32",
        (-1 - (F.shiftleft("part", 40) + F.col("full") + F.col("k"))).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    return first.unionByName(full)


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    """Contract: the pieces of all documents in as few sequences as the search finds."""
    import public_tokenizers

    return packed_whole(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
