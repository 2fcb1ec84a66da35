"""Rollups of views, searches and clicks, and the rankings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.operators.ranking import numbered, top_rows
from colophon.session import reuse

PERIOD_NAMES = [name for name, _ in K.PERIODS]


def period_cutoff(as_of: str, days: int | None) -> Column | None:
    """First moment that counts for a period, or None for everything."""
    if days is None:
        return None
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")


def period_counts(events: DataFrame, key: Column, as_of: str, name: str) -> DataFrame:
    """One pass over an event table: a count per key for each period."""
    stamp = F.col("ts").cast("timestamp_ntz")
    aggs = [
        (F.count("*") if cutoff is None else F.count_if(stamp >= cutoff)).alias(f"{name}_{period}")
        for period, days in K.PERIODS
        for cutoff in [period_cutoff(as_of, days)]
    ]
    return events.groupBy(key.alias(f"{name}_key")).agg(*aggs)


def work_period_counts(works: DataFrame, views: DataFrame, searches: DataFrame, clicks: DataFrame, as_of: str) -> DataFrame:
    """Published works with ``views/searches/clicks_<period>`` columns.

    Every event table is aggregated to one row per key before it meets the works, so a hot
    work costs one row in the join.
    """
    out = works.filter("is_published").withColumn("code_key", F.upper("product_code"))
    for events, key, name, on in (
        (views, F.col("work_id"), "views", "id"),
        (searches, F.upper("product_code"), "searches", "code_key"),
        (clicks, F.col("work_id"), "clicks", "id"),
    ):
        counts = period_counts(events, key, as_of, name)
        out = out.join(counts, out[on] == counts[f"{name}_key"], "left").drop(f"{name}_key")
    zeros = {f"{n}_{p}": 0 for n in ("views", "searches", "clicks") for p in PERIOD_NAMES}
    return out.fillna(zeros)


def _by_period(df: DataFrame, fixed: list[str], measures: list[str]) -> DataFrame:
    """Wide period columns to one row per period."""
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("period"), *[F.col(f"{m}_{p}").alias(m) for m in measures])
            for p in PERIOD_NAMES
        ]
    )
    return df.select(*fixed, F.inline(rows))


def discovery_metrics(works: DataFrame, views: DataFrame, searches: DataFrame, clicks: DataFrame, as_of: str) -> DataFrame:
    """Metrics per work, performer, maker and series for day, week, month and all time.

    A work's rank follows popularity, not score.  Works are ranked once, because their rank
    is the same in every period.
    """
    published = reuse(works.filter("is_published"))
    ranked = numbered(published, [], [("popularity", "desc"), ("product_code", "asc")])
    counted = reuse(work_period_counts(ranked, views, searches, clicks, as_of))
    measures = ["views", "searches", "clicks"]
    work_rows = (
        _by_period(counted.withColumn("entity_key", F.col("code_key")), ["entity_key", "rank"], measures)
        .withColumn("score", (F.col("searches") + K.CLICK_WEIGHT * F.col("clicks")).cast("double"))
        .select(
            F.lit("work").alias("entity_type"), "entity_key", "period", "views", "searches", "clicks", "score", "rank",
            F.lit(None).cast("bigint").alias("work_count"),
        )
    )
    return work_rows.unionByName(_entity_metrics(counted))


def _entity_metrics(counted: DataFrame) -> DataFrame:
    entities = counted.select(
        F.inline(
            F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("entity_key")) for t in K.ENTITY_TYPES])
        ),
        "product_code",
        "popularity",
        *[f"{m}_{p}" for m in ("searches", "clicks") for p in PERIOD_NAMES],
    ).filter("entity_key is not null")
    # aggregate all periods side by side, then turn the few result rows; product_code is unique
    sums = [F.sum(f"{m}_{p}").alias(f"{m}_{p}") for m in ("searches", "clicks") for p in PERIOD_NAMES]
    grouped = reuse(entities.groupBy("entity_type", "entity_key").agg(
        *sums, F.sum(F.coalesce("popularity", F.lit(0))).alias("popularity"), F.count("product_code").alias("work_count")
    ))
    rows = _by_period(grouped, ["entity_type", "entity_key", "popularity", "work_count"], ["searches", "clicks"])
    score = F.col("searches") + K.CLICK_WEIGHT * F.col("clicks") + F.col("popularity") * K.POPULARITY_WEIGHT
    rows = rows.withColumn("score", F.round(score.cast("double"), 6))
    ranked = numbered(rows, ["period", "entity_type"], [("score", "desc"), ("entity_key", "asc")])
    return ranked.select(
        "entity_type", "entity_key", "period", F.lit(0).cast("bigint").alias("views"), "searches", "clicks", "score", "rank", "work_count"
    )


def discovery_metrics_v1(works: DataFrame, searches: DataFrame, clicks: DataFrame, as_of: str) -> DataFrame:
    """The older rule: only works with events have a row, click rows merge into search rows and
    lose their rank, entities also count unpublished works."""
    s = period_counts(searches, F.upper("product_code"), as_of, "searches")
    codes = works.select(F.col("id").alias("work_id"), F.upper("product_code").alias("product_code"))
    c = period_counts(clicks.join(codes, "work_id"), F.col("product_code"), as_of, "clicks")
    both = s.join(c, s.searches_key == c.clicks_key, "full_outer").withColumn(
        "entity_key", F.coalesce("searches_key", "clicks_key")
    )
    zeros = {f"{n}_{p}": 0 for n in ("searches", "clicks") for p in PERIOD_NAMES}
    events = both.fillna(zeros)
    rows = _by_period(events, ["entity_key"], ["searches", "clicks"]).filter("searches + clicks > 0")
    alone = F.when(F.col("clicks") == 0, "search").when(F.col("searches") == 0, "click").otherwise("merged")
    rows = rows.withColumn("kind", alone)
    # a search row is ranked among all searched works, a click row among all clicked works
    searched = numbered(rows.filter("searches > 0"), ["period"], [("searches", "desc"), ("entity_key", "asc")])
    clicked = numbered(rows.filter("clicks > 0"), ["period"], [("clicks", "desc"), ("entity_key", "asc")])
    work_rows = searched.withColumn("rank", F.when(F.col("kind") == "search", F.col("rank"))).unionByName(
        clicked.filter("kind = 'click'")
    ).select(
        F.lit("work").alias("entity_type"), "entity_key", "period", "searches", "clicks",
        (F.col("searches") + K.CLICK_WEIGHT * F.col("clicks")).cast("double").alias("score"), "rank",
        F.lit(None).cast("bigint").alias("work_count"),
    )
    counted = works.withColumn("code_key", F.upper("product_code")).join(
        events.withColumnRenamed("entity_key", "code_key"), "code_key", "left"
    ).fillna(zeros)
    return work_rows.unionByName(_entity_metrics(counted).drop("views"))


def keyword_metrics(logs: DataFrame, as_of: str) -> DataFrame:
    """Web searches per code for week, month and all time, ranked within the period."""
    counts = period_counts(logs.filter("source = 'web_search'"), F.col("product_code"), as_of, "searches")
    periods = [p for p, _ in K.KEYWORD_PERIODS]
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"searches_{p}").alias("searches")) for p in periods])
    long = counts.select(F.col("searches_key").alias("entity_key"), F.inline(rows)).filter("searches > 0")
    ranked = numbered(long, ["period"], [("searches", "desc"), ("entity_key", "asc")])
    return ranked.select("entity_key", "period", "searches", F.col("searches").cast("double").alias("score"), "rank")


def entity_ranking(metrics: DataFrame, entity_type: str, period: str = "week", limit: int = 50) -> DataFrame:
    """Stored metrics of one kind and period, by rank."""
    rows = metrics.filter((F.col("entity_type") == entity_type) & (F.col("period") == period))
    return top_rows(rows, [("rank", "asc"), ("entity_key", "asc")], limit)


def search_counts(logs: DataFrame, works: DataFrame) -> DataFrame:
    """Searches per published code.  Logs are counted first; the join sees one row per code.

    Two published works whose codes differ only in case both match, as in an inner join on
    the raw logs: their count is multiplied.
    """
    counts = logs.groupBy(F.upper("product_code").alias("product_code")).agg(F.count("*").alias("n"))
    codes = works.filter("is_published").groupBy(F.upper("product_code").alias("product_code")).agg(F.count("*").alias("m"))
    return counts.join(codes, "product_code").select("product_code", (F.col("n") * F.col("m")).alias("search_count"))


def popular_works(logs: DataFrame, works: DataFrame, limit: int = 20) -> DataFrame:
    return top_rows(search_counts(logs, works), [("search_count", "desc"), ("product_code", "asc")], limit)


def popular_works_period(
    logs: DataFrame, works: DataFrame, as_of: str, days: int | None = None, limit: int = 40, offset: int = 0
) -> DataFrame:
    cutoff = period_cutoff(as_of, days)
    if cutoff is not None:
        logs = logs.filter(F.col("ts").cast("timestamp_ntz") >= cutoff)
    return top_rows(search_counts(logs, works), [("search_count", "desc"), ("product_code", "asc")], limit, offset)


def performer_ranking(logs: DataFrame, works: DataFrame, limit: int = 8, top_works: int | None = None) -> DataFrame:
    """Searches of all works, or of the ``top_works`` most searched, summed per performer; each work counts at least once."""
    top = search_counts(logs, works) if top_works is None else popular_works(logs, works, top_works)
    named = works.filter("is_published and performer is not null").select(F.upper("product_code").alias("product_code"), "performer")
    sums = top.join(named, "product_code").groupBy("performer").agg(F.sum(F.greatest("search_count", F.lit(1))).alias("searches"))
    return top_rows(sums, [("searches", "desc"), ("performer", "asc")], limit)
