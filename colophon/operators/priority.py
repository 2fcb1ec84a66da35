"""Candidate prioritisation: merging sorts, lanes with quotas, distribution figures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.operators.greedy import winners
from colophon.operators.joins import lookup
from colophon.operators.ranking import Order, nearest_ranks, numbered, top_rows
from colophon.operators.staging import class_counts
from colophon.session import reuse

# text is compared in binary order
CANDIDATE_ORDER: Order = [("priority_score", "desc"), ("release_date", "desc"), ("code_key", "asc"), ("external_product_id", "asc"), ("position", "asc")]


def merge_candidates(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merged, conflicts)``: one candidate per id; rows without an id join by code.

    ``inputs(position, external_product_id, code_key, sort, rank_position, priority_score,
    popularity_signal, review_signal, payload_hash, raw)``.  The best rank brings its score,
    the first review signal is kept, each sort keeps its first payload.  A code under two
    ids, an id under two codes, or two payloads in one sort go to ``conflicts``.
    """
    named = inputs.filter("external_product_id is not null and code_key is not null")
    owner = named.groupBy("code_key").agg(F.min_by("external_product_id", "position").alias("_owner"))
    rows = inputs.join(owner, "code_key", "left")
    group = F.coalesce(F.concat(F.lit("id:"), F.coalesce("external_product_id", "_owner")), F.concat(F.lit("code:"), "code_key"), F.concat(F.lit("row:"), F.col("position").cast("string")))
    rows = reuse(rows.withColumn("_g", group))
    coded = F.when(F.col("code_key").isNotNull(), F.col("position"))
    firsts = rows.groupBy("_g").agg(F.min_by(F.struct("code_key", "_owner"), coded).alias("_f"))
    firsts = firsts.select("_g", F.col("_f.code_key").alias("_code"), F.col("_f._owner").alias("_code_owner"))
    by_sort = rows.groupBy("_g", "sort").agg(F.min_by("payload_hash", "position").alias("_hash"), F.min_by(F.struct("raw", F.col("position").alias("raw_source_position"), "payload_hash"), "position").alias("_prov"))
    j = rows.join(firsts, "_g").join(by_sort.drop("_prov"), ["_g", "sort"])
    issue = (
        F.when(F.col("external_product_id") != F.col("_code_owner"), "PROVENANCE_CONFLICT_EXTERNAL_ID")
        .when(F.col("code_key").isNotNull() & (F.col("code_key") != F.col("_code")), "PROVENANCE_CONFLICT_NORMALIZED_CODE")
        .when(F.col("payload_hash") != F.col("_hash"), F.concat(F.lit("PROVENANCE_CONFLICT_"), F.upper("sort")))
    )
    judged = j.withColumn("issue", issue)
    good = judged.filter("issue is null")
    best = F.struct(F.col("rank_position").isNull().alias("a"), F.col("rank_position").alias("b"), F.col("position").alias("c"))
    shown = F.when(F.col("review_signal") != "NONE", F.col("position"))
    merged = good.groupBy("_g").agg(
        F.min("position").alias("position"), F.min_by("external_product_id", "position").alias("external_product_id"), F.min_by("code_key", "position").alias("code_key"),
        F.array_sort(F.collect_set("sort")).alias("query_sorts"), F.min("rank_position").alias("rank_position"),
        F.min_by("priority_score", best).alias("priority_score"), F.min_by("popularity_signal", best).alias("popularity_signal"),
        F.coalesce(F.min_by("review_signal", shown), F.lit("NONE")).alias("review_signal"),
    )
    provenance = by_sort.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("sort", "_prov"))).alias("provenance"))  # one entry per sort
    return merged.join(provenance, "_g").drop("_g"), judged.filter("issue is not null").select("position", "external_product_id", "code_key", "issue")


def lane_targets(size: int) -> dict[str, int]:
    if size < 1:
        raise ValueError("target size must be 1 at least")
    out = {lane: math.floor(size * K.LANE_RATIOS[lane]) for lane in K.LANES if lane in K.LANE_RATIOS}
    out["BACKFILL"] = size - sum(out.values())
    return out


def _order_key() -> Column:
    """``CANDIDATE_ORDER`` as one ascending struct: falling dates by mirrored digits, nulls last."""
    mirrored = F.translate("release_date", "0123456789", "9876543210")
    parts = [(-F.col("priority_score")), mirrored, F.col("code_key"), F.col("external_product_id")]
    fields = [x.alias(f"k{i}{j}") for i, c in enumerate(parts) for j, x in enumerate((c.isNull(), c))]
    return F.struct(*fields, "position")


def _pick(pool: DataFrame, taken: DataFrame | None, limit: int) -> DataFrame:
    """First ``limit`` candidates in order that repeat neither an id nor a code.

    A row that is the first of its id and of its code is picked for sure, so the ``limit``-th of these
    says how far down the order the picks can reach; what comes after it is left out.
    """
    if limit <= 0:
        return pool.filter("false")
    keys = ["external_product_id", "code_key"]
    for key in keys if taken is not None else []:
        used = taken.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_used", F.lit(True))
        pool = lookup(pool, used, key, spread=[F.col("position")]).filter("_used is null").drop("_used")
    keyed = reuse(pool.withColumn("_place", _order_key()), "lane")
    sure = keyed.select("_place", *keys)
    for i, key in enumerate(keys):
        sure = lookup(sure, keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("_place").alias(f"_h{i}")), key)
    sure = sure.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_h{i}") == F.col("_place"), F.lit(True)) for i in range(len(keys))]))
    reach = sure.orderBy("_place").limit(limit).agg(F.count("*").alias("_n"), F.max("_place").alias("_last"))
    # one row
    rows = keyed.crossJoin(F.broadcast(reach)).filter((F.col("_n") < limit) | (F.col("_place") <= F.col("_last")))
    won = winners(rows.select("_place", *keys), keys, "_place").unionByName(keyed.filter(F.coalesce(*keys).isNull()).select("_place"))
    return reuse(keyed.join(won.orderBy("_place").limit(limit), "_place").drop("_place"), "picked")


def select_lanes(ranked: DataFrame, latest: DataFrame, backfill: DataFrame, size: int) -> DataFrame:
    """Fill the lanes in turn; a shortfall is topped up from the latest works only.

    Candidate columns: ``position, external_product_id, code_key, release_date, age_days,
    rank_position, priority_score``.
    """
    targets = lane_targets(size)
    popular = ranked.filter((F.col("rank_position").isNotNull()) & (F.col("age_days") <= K.POPULAR_MAX_AGE_DAYS))
    chosen: DataFrame | None = None
    for lane, pool in zip(K.LANES, (popular, latest, backfill)):
        picked = _pick(pool, chosen, targets[lane]).withColumn("lane", F.lit(lane))
        chosen = picked if chosen is None else chosen.unionByName(picked)
    missing = size - chosen.count()
    if missing > 0:
        chosen = chosen.unionByName(_pick(latest, chosen, missing).withColumn("lane", F.lit("LATEST")))
    young = F.coalesce(F.col("age_days") <= K.LATEST_PROTECTION_DAYS, F.lit(False))
    reason = (
        F.when(F.col("lane") == "RECENT_POPULAR", F.array(F.lit("OFFICIAL_RANK_ORDER"), F.lit("WITHIN_180_DAYS")))
        .when(F.col("lane") == "LATEST", F.array(F.when(young, "LATEST_0_7_DAY_PROTECTION").otherwise("LATEST_DATE_ORDER")))
        .otherwise(F.array(F.lit("DURABLE_BACKFILL_FRONTIER")))
    )
    return numbered(chosen.withColumn("reason", reason), [], CANDIDATE_ORDER, "priority_position")


def distribution_metrics(df: DataFrame) -> DataFrame:
    """Counts, nearest-rank age percentiles and coverage of a candidate set."""
    total = F.count("*")
    counts = df.agg(
        total.alias("count"), F.count_if(F.col("age_days") <= 30).alias("recent_30_days"), F.count_if(F.col("age_days") <= 90).alias("recent_90_days"),
        F.coalesce(F.count("rank_position") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("popularity_coverage"), F.count_if("already_exists").alias("existing_count"),
    )
    ages = nearest_ranks(df, [], {"median_age_days": ("age_days", 0.5), "p90_age_days": ("age_days", 0.9)})
    return counts.crossJoin(F.broadcast(ages)).select(  # one row each
        "count", *[F.col(c).cast("bigint").alias(c) for c in ("median_age_days", "p90_age_days")], "recent_30_days", "recent_90_days", "popularity_coverage", "existing_count"
    )


def top_groups(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return top_rows(counts, [("n", "desc"), ("name", "asc")], limit)


def lane_counts(df: DataFrame) -> DataFrame:
    return class_counts(df, "lane", K.LANES)


def age_bucket_counts(df: DataFrame) -> DataFrame:
    return class_counts(df, "age_bucket", K.AGE_BUCKETS)


def older_in_top(df: DataFrame, order: Order, top: int = 50, days: int = 180) -> DataFrame:
    """How many of the first ``top`` candidates are older than ``days``."""
    return top_rows(df, order, top).agg(F.count_if(F.col("age_days") > days).alias("older"), F.count("*").alias("checked"))


def run_stats(entries: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """State counts, latency figures and idle gaps per run.

    ``entries(run_id, state, started_ms, finished_ms)``; a gap is the pause before the next
    start.  Entries are numbered and joined to their predecessor, so one long run is spread
    over the cluster like many short ones.
    """
    placed = numbered(entries, ["run_id"], [("started_ms", "asc"), ("finished_ms", "asc")], "_place")
    before = placed.select("run_id", (F.col("_place") + 1).alias("_place"), F.col("finished_ms").alias("_before"))
    rows = placed.join(before, ["run_id", "_place"], "left")
    rows = rows.withColumns({"latency": F.col("finished_ms") - F.col("started_ms"), "gap": F.col("started_ms") - F.col("_before")})
    rows = reuse(rows, "latencies")
    counts = rows.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in states],
        F.coalesce(F.avg("latency"), F.lit(0.0)).alias("latency_avg"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_avg"),
    )
    ranks = nearest_ranks(rows, ["run_id"], {"latency_p50": ("latency", 0.5), "latency_p95": ("latency", 0.95), "gap_p95": ("gap", 0.95)})
    figures = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("latency_p50", "latency_p95", "gap_p95")]
    named = ranks.withColumnRenamed("run_id", "_run")
    return counts.join(named, F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", "total", *[s.lower() for s in states], "latency_avg", *figures[:2], "gap_avg", figures[2])
