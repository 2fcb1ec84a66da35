"""First-come selection where a row blocks later rows with the same id or the same code.

The outcome equals a scan in order.  Rows with equal keys are one row, and keys become numbers once.
As soon as what is undecided fits a task, one task scans it.  Until then rounds of grouped minima
keep the rows that come first in all their keys and drop those that share a key with them, which
settles all but alternating chains, and the rest falls into connected components:

* each component that fits a task is scanned on its own;
* in larger ones, rows with a single earlier neighbour depend on that one alone, and pointer jumping
  follows such chains to their beginning, so a chain of n rows takes log n joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colophon.operators.graph import components
from colophon.operators.joins import lookup
from colophon.session import reuse

#: rows that one task may scan
LOCAL = 100_000
#: rounds of grouped minima before the rest is looked at
OPENING = 2


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_g")]


def _with_heads(rows: DataFrame) -> DataFrame:
    """``_h0``, ``_h1`` ...: the first row of each key's rows."""
    for i, g in enumerate(_keys(rows)):
        heads = rows.filter(F.col(g).isNotNull()).groupBy(g).agg(F.min_by("_row", "_at").alias(f"_h{i}"))
        rows = lookup(rows, heads, g, spread=[F.col("_row")])
    return rows


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _without(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that share no key with a kept one and are none themselves."""
    keys = _keys(rows)
    for i, g in enumerate(keys):
        taken = kept.filter(F.col(g).isNotNull()).select(g).distinct().withColumn(f"_t{i}", F.lit(True))
        rows = lookup(rows, taken, g, spread=[F.col("_row")])
    free = _all([F.col(f"_t{i}").isNull() for i in range(len(keys))])
    return rows.filter(free).drop(*[f"_t{i}" for i in range(len(keys))])


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and those that stay undecided."""
    headed = reuse(_with_heads(rows), "headed")
    n = len(_keys(rows))
    kept = headed.filter(_all([F.coalesce(F.col(f"_h{i}") == F.col("_row"), F.lit(True)) for i in range(n)])).select(*rows.columns)
    return kept, reuse(_without(rows, kept), "undecided")


def _scan(rows: DataFrame, by: str | None) -> DataFrame:
    """Scans rows in order, each component (or all of them) in one task; returns the kept ones."""
    keys = _keys(rows)
    dealt = rows.repartition(1).sortWithinPartitions("_at") if by is None else rows.repartition(by).sortWithinPartitions(by, "_at")
    slim = dealt.select("_row", *keys, *([by] if by else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[set] = [set() for _ in keys]
        now = None
        for batch in batches:
            held = []
            groups = batch.column(by).to_pylist() if by else [None] * batch.num_rows
            for row, group, *own in zip(batch.column("_row").to_pylist(), groups, *(batch.column(g).to_pylist() for g in keys)):
                if group != now:
                    now, taken = group, [set() for _ in keys]
                if not any(k is not None and k in t for k, t in zip(own, taken)):
                    held.append(row)
                    for k, t in zip(own, taken):
                        t.add(k)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], ["_row"])

    return rows.join(slim.mapInArrow(work, "_row bigint"), "_row", "left_semi").select(*[c for c in rows.columns if c != by])


def _chains(rows: DataFrame, report: list) -> DataFrame:
    """Rows that are kept for sure by following single earlier neighbours to a row that has none."""
    n = len(_keys(rows))
    headed = reuse(_with_heads(rows), "headed")
    places = headed
    for i, g in enumerate(_keys(rows)):
        later = headed.filter(F.col(g).isNotNull() & (F.col(f"_h{i}") != F.col("_row")))
        places = lookup(places, later.groupBy(g).agg(F.min_by("_row", "_at").alias(f"_s{i}")), g, spread=[F.col("_row")])
    # per key: no earlier row, one (the head), or more
    earlier = [F.when(F.col(f"_h{i}").isNull() | (F.col(f"_h{i}") == F.col("_row")), 0).when(F.col(f"_s{i}") == F.col("_row"), 1).otherwise(2) for i in range(n)]
    total = reduce(lambda a, b: a + b, earlier)
    before = F.coalesce(*[F.when(e == 1, F.col(f"_h{i}")) for i, e in enumerate(earlier)])
    # (row, where its chain leads so far, whether an odd number of steps away, whether the chain ends there, whether that end is known)
    links = places.select("_row", F.when(total == 1, before).otherwise(F.col("_row")).alias("_to"), (total == 1).alias("_odd"), (total != 1).alias("_end"), (total == 0).alias("_known"))
    links = reuse(links, "links")
    while links.filter("not _end").limit(1).count():
        report.append("jump")
        step = links.select(F.col("_row").alias("_to"), F.col("_to").alias("_to2"), F.col("_odd").alias("_odd2"), F.col("_end").alias("_end2"), F.col("_known").alias("_known2"))
        # a chain that has ended points at its end, and that at itself
        links = reuse(links.join(step, "_to").select("_row", F.col("_to2").alias("_to"), (F.col("_odd") != F.col("_odd2")).alias("_odd"), F.col("_end2").alias("_end"), F.col("_known2").alias("_known")), "links")
    return rows.join(links.filter("_known and not _odd").select("_row"), "_row", "left_semi")


def winners(df: DataFrame, keys: list[str], order: str, local: int = LOCAL, report: list | None = None) -> DataFrame:
    """The ``order`` of the rows that ``first_come`` keeps, those without any key aside.  Reads ``df`` once."""
    report = report if report is not None else []
    keyed = df.filter(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys]))
    # of rows alike in all keys only the first can be kept
    tuples = reuse(keyed.groupBy(*keys).agg(F.min(order).alias("_at")).withColumn("_row", F.monotonically_increasing_id()), "tuples")
    rows = tuples
    for i, k in enumerate(keys):
        heads = tuples.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min_by("_row", "_at").alias(f"_g{i}"))
        rows = lookup(rows, heads, k, spread=[F.col("_row")])
    rows = reuse(rows.select("_row", "_at", *[f"_g{i}" for i in range(len(keys))]), "rows")
    kept: list[DataFrame] = []
    for turn in count():
        left = rows.count()
        if left <= local:
            report.append("scan")
            kept.append(_scan(rows, None))
            break
        if turn % (OPENING + 1) < OPENING:
            report.append("round")
            first, rows = _round(rows)
            kept.append(first)
            continue
        # each row hangs on the first row of each of its keys
        headed = reuse(_with_heads(rows), "headed")
        hangs = reduce(DataFrame.unionByName, [headed.filter(F.col(f"_h{i}").isNotNull()).select(F.col("_row").alias("u"), F.col(f"_h{i}").alias("v")) for i in range(len(keys))])
        rooted = rows.join(components(hangs).withColumnRenamed("node", "_row"), "_row", "left").withColumn("root", F.coalesce("root", "_row"))
        rooted = reuse(rooted, "rooted")
        large = reuse(rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > local).select("root"), "large")
        report.append("components")
        kept.append(_scan(rooted.join(large, "root", "left_anti"), "root"))
        rows = reuse(rooted.join(large, "root", "left_semi").drop("root"), "large")
        sure = reuse(_chains(rows, report), "chains")
        kept.append(sure)
        rows = reuse(_without(rows, sure), "undecided")
    return reduce(DataFrame.unionByName, [k.select(F.col("_at").alias(order)) for k in kept])


def first_come(df: DataFrame, keys: list[str], order: str, local: int = LOCAL, report: list | None = None) -> DataFrame:
    """Rows kept when rows are taken by ``order`` (unique) and a null key blocks nothing.

    ``report`` gets an entry a round, for tests.
    """
    won = winners(df, keys, order, local, report).withColumn("_won", F.lit(True))
    return df.join(won, order, "left").filter(F.col("_won") | _all([F.col(k).isNull() for k in keys])).select(*df.columns)
