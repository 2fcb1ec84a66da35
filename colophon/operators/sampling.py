"""Spread-out samples for review, and index choices within a work's images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from colophon.operators.greedy import first_come
from colophon.operators.ranking import Order, numbered
from colophon.session import reuse

_BY_CONFIDENCE: Order = [("_confidence", "asc"), ("_score", "desc"), ("created_at", "asc"), ("code", "asc")]


def _first(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("_place").limit(n).select("_place", "code", "_group")


def _unused(pool: DataFrame, picked: DataFrame) -> DataFrame:
    """The first row of each code that is not picked yet."""
    rest = pool.join(picked.select("code"), "code", "left_anti")
    return rest.groupBy("code").agg(F.min("_place").alias("_place"), F.min_by("_group", "_place").alias("_group"))


def _sample(df: DataFrame, targets: dict[str, int], order: Order, unique_share: float, whole: bool = False) -> DataFrame:
    """Mode by mode: rows of unused codes and groups until the share is reached, then rows of
    unused codes after the last of them, then, if still short, the first rows of unused codes.

    A code is used once over all modes.  With ``whole`` a mode that stays short is an error.  The
    driver sees counts only.
    """
    group = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("maker", "series")])
    keyed = df.filter(F.col("mode").isin(*targets)).withColumn("_group", group)
    ties: Order = [(c, "asc") for c in ("code", "maker", "series") if c not in dict(order)]
    rows = reuse(numbered(keyed, [], [("mode", "asc"), *order, *ties], "_place"))
    used = rows.filter("false").select("_place", "code", "_group")
    for mode, target in targets.items():
        pool = rows.filter(F.col("mode") == mode).select("_place", "code", "_group").join(used.select("code"), "code", "left_anti")
        fresh = pool.join(used.select("_group").distinct(), "_group", "left_anti")
        spread_until = math.ceil(target * unique_share)
        picked = reuse(_first(first_come(fresh, ["code", "_group"], "_place"), spread_until))
        n, last = picked.agg(F.count("*"), F.max("_place")).first()
        if 0 < n == spread_until < target:
            picked = reuse(picked.unionByName(_first(_unused(pool.filter(F.col("_place") > last), picked), target - n)))
            n = picked.count()
        if n < target:
            picked = reuse(picked.unionByName(_first(_unused(pool, picked), target - n)))
            if whole and (n := picked.count()) < target:
                raise ValueError(f"HOLDOUT_SHORT:{mode}:{n}:{target}")
        used = used.unionByName(picked)
    return rows.join(used.select("_place"), "_place", "left_semi").select(*df.columns)


def stratified_sample(df: DataFrame, targets: dict[str, int]) -> DataFrame:
    """``targets`` rows per mode, best confidence and score first.

    Until half a target is reached, each (maker, series) group is used once; groups are shared
    between the modes.  ``df(code, mode, confidence, score, created_at, maker, series)``.
    """
    level = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).when(F.col("confidence") == "none", 3).otherwise(4)
    rows = df.withColumns({"_confidence": level, "_score": F.coalesce(F.nullif(F.col("score").cast("double"), F.lit(0.0)), F.lit(-999.0))})
    return _sample(rows, targets, _BY_CONFIDENCE, 0.5).drop("_confidence", "_score")


def holdout_sample(df: DataFrame, targets: dict[str, int], exclude: DataFrame, full_first: str = "PACKAGE_FULL") -> DataFrame:
    """``targets`` rows per mode in hash order, each group once, then anything unused.

    Class A goes first for the full package mode.  ValueError if a mode has too few rows.
    """
    rows = df.join(exclude.select("code").distinct(), "code", "left_anti")
    first = F.when((F.col("mode") == full_first) & (F.col("classification") != "A"), 1).otherwise(0)
    rows = rows.withColumns({"_first": first, "_hash": F.sha2("code", 256)})
    return _sample(rows, targets, [("_first", "asc"), ("_hash", "asc")], 1.0, True).drop("_first", "_hash")


def even_indices(total: Column, maximum: int = 8) -> Column:
    """Evenly spaced 1-based indices, both ends included."""
    n = F.least(total, F.lit(maximum))
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.floor(i * (total - 1) / (n - 1) + 0.5) + 1).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(1))).otherwise(F.array_sort(F.array_distinct(spaced)))


def spread_indices(total: Column, chosen: Column, maximum: int = 8) -> Column:
    """Up to ``maximum`` further indices, each as far as possible from all chosen so far."""
    free = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    start = F.struct(chosen.cast("array<int>").alias("all"), F.array().cast("array<int>").alias("new"))

    def step(state, _):
        left = F.array_except(free, state["all"])
        scored = F.transform(left, lambda i: F.struct((-F.array_min(F.transform(state["all"], lambda c: F.abs(c - i)))).alias("d"), i.alias("i")))
        best = F.array_min(scored)["i"]
        more = F.when(best.isNull(), F.array().cast("array<int>")).otherwise(F.array(best))
        return F.struct(F.concat(state["all"], more).alias("all"), F.concat(state["new"], more).alias("new"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(maximum)), start, step)
    return F.array_sort(done["new"])
