"""Numbering, running totals, top-k and latest-per-key.

A window over a whole table, or over one large group, is a single task.  Here the rows are dealt
into ranges of the order and written once, each range is numbered on its own, and the number (or
the sum) of the earlier ranges is added from a table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colophon.session import partitions_of, reuse

Order = list[tuple[str, str]]  # (column, "asc" | "desc"); nulls always come last


def order_by(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]


def _ranged(df: DataFrame, order: Order, buckets: int | None) -> DataFrame:
    """The rows, written once, with the number of their range of ``order`` in ``_bucket``."""
    buckets = buckets or partitions_of(df.sparkSession)
    dealt = df.repartitionByRange(buckets, *order_by(order)).withColumn("_bucket", F.spark_partition_id())
    return reuse(dealt, "ranged")


def numbered(df: DataFrame, keys: list[str], order: Order, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Exact ``row_number`` within ``keys`` (or over all rows) without one task per group.

    ``order`` must end in a column that is unique within a group.
    """
    full: Order = [(k, "asc") for k in keys] + [o for o in order if o[0] not in keys]
    cut = _ranged(df, full, buckets)
    counts = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and key in it
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order_by(order))))
    on = [ranked["_bucket"] == offsets["_bucket"]] + [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    keep = [ranked[c] for c in df.columns]
    return ranked.join(offsets, on, "left").select(
        *keep, (ranked["_local"] + F.coalesce(offsets["_before"], F.lit(0))).cast("bigint").alias(name)
    )


def running_totals(df: DataFrame, order: Order, values: dict[str, str], buckets: int | None = None) -> DataFrame:
    """For each new column of ``values``, the sum of the named column over all earlier rows in ``order``.

    The values must be non-negative integers without nulls.  Rows that are equal in ``order`` follow
    one another in any order, so end it in columns that tell rows apart as far as it matters.
    """
    cut = _ranged(df, order, buckets)
    totals = cut.groupBy("_bucket").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, at most as many as shuffle partitions: the one task and the broadcast stay small
    offsets = F.broadcast(
        totals.select("_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values])
    )
    local = Window.partitionBy("_bucket").orderBy(*order_by(order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(n) for n, v in values.items()])
    return summed.join(offsets, "_bucket").select(
        *df.columns, *[(F.col(n) + F.col(f"_{n}")).cast("bigint").alias(n) for n in values]
    )


def nearest_ranks(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Nearest-rank percentiles per group: ``wanted`` names a value column and a share for each new column.

    Values are counted, and a value's rank is a running total over ranges of (group, value), so no
    task holds the values of a large group.  Nulls are left out; a group without values has nulls.
    """
    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Left join on the keys, nulls as values; on one row without keys."""
        if not keys:
            return left.crossJoin(F.broadcast(right))
        named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        return left.join(named, on, "left").drop(*[f"_key_{k}" for k in keys])

    out = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
        placed = reuse(running_totals(counts, [(c, "asc") for c in (*keys, value)], {"_before": "_n"}), "places")
        groups = placed.groupBy(*keys).agg(F.min("_before").alias("_base"), F.sum("_n").alias("_total"))
        upto = F.col("_before") - F.col("_base") + F.col("_n")
        picks = [F.min(F.when(upto >= F.ceil(F.col("_total") * share - 1e-9), F.col(value))).alias(name) for name, (v, share) in wanted.items() if v == value]
        out = met(out, met(placed, groups).groupBy(*keys).agg(*picks))
    return out


def top_within(df: DataFrame, keys: list[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  Spark trims each task to ``k`` rows before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by(order)))
    return df.withColumn(name, n).filter(F.col(name) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row per key in the given order (``DISTINCT ON``)."""
    return top_within(df, keys, order, 1, "__place").drop("__place")


def top_rows(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """Page of an ordered list: as many rows as the caller asks for, offset from 0."""
    out = df.orderBy(*order_by(order))
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Next page after the last key seen; no offset to skip over."""
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(key).limit(max(1, limit))


def observation_span(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """First and last value of each field per record, by observation order."""
    aggs = []
    for f in fields:
        aggs.append(F.min_by(f, order).alias(f"first_{f}"))
        aggs.append(F.max_by(f, order).alias(f"last_{f}"))
    return df.groupBy(*keys).agg(*aggs)


def best_and_runner_up(df: DataFrame, keys: list[str], order: Order, score: str, fields: list[str]) -> DataFrame:
    """Best and second candidate per key with the score gap."""
    top = top_within(df, keys, order, 2, "_place")
    picked = [
        F.max(F.when(F.col("_place") == place, F.col(f))).alias(f"{prefix}_{f}")
        for place, prefix in ((1, "best"), (2, "runner"))
        for f in [*fields, score]
    ]
    out = top.groupBy(*keys).agg(*picked)
    return out.withColumn("score_delta", F.col(f"best_{score}") - F.coalesce(F.col(f"runner_{score}"), F.lit(0)))
