"""Performers, related works, recommendations and mixed pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.operators.joins import by_key
from colophon.operators.ranking import Order, numbered, top_rows, top_within
from colophon.session import partitions_of, reuse


def performer_stats(works: DataFrame, performer: str | None = None) -> DataFrame:
    """Works and distinct makers, of one performer or of all."""
    out = works.filter("is_published and performer is not null")
    if performer is not None:
        out = out.filter(F.col("performer") == performer)
    # one row per (performer, maker) first: the distinct count needs no expansion
    pairs = out.groupBy("performer", "maker").agg(F.count("*").alias("n"))
    return pairs.groupBy("performer").agg(F.sum("n").alias("work_count"), F.count("maker").alias("maker_count"))


def performers_sharing(works: DataFrame, performer: str, column: str, limit: int | None = 8) -> DataFrame:
    """Other performers with works of the same makers (or genres) as one performer; all of them without a limit."""
    published = works.filter("is_published")
    mine = published.filter((F.col("performer") == performer) & F.col(column).isNotNull()).select(column).distinct()
    others = published.filter(F.col("performer").isNotNull() & (F.col("performer") != performer))
    grouped = others.join(mine, column, "left_semi").groupBy("performer").agg(
        F.count("*").alias("work_count"), F.sum(F.coalesce("popularity", F.lit(0))).alias("popularity")
    )
    order = [("popularity", "desc"), ("work_count", "desc"), ("performer", "asc")]
    return grouped if limit is None else top_rows(grouped, order, limit)


def recommend(works: DataFrame, context: dict | None = None, limit: int = 12) -> DataFrame:
    """Published works by popularity and a visitor's context, best first."""
    context = context or {}
    w = K.RECOMMEND_WEIGHTS
    score = F.coalesce("popularity", F.lit(0)) * w["popularity"] + F.coalesce("favorite_count", F.lit(0)) * w["favorite_count"]
    for field in ("performer", "maker", "series"):
        if context.get(field):
            score = score + F.when(F.col(field) == context[field], w[field]).otherwise(0)
    if context.get("genres"):
        score = score + F.when(F.coalesce("genre", F.lit("")).isin(*context["genres"]), w["genre"]).otherwise(0)
    return top_rows(works.filter("is_published").withColumn("score", score.cast("double")), [("score", "desc"), ("id", "asc")], limit)


TERMS = ("performer", "maker", "series", "genre")


def recommend_all(works: DataFrame, profiles: DataFrame, limit: int = 12) -> DataFrame:
    """The best ``limit`` works of every visitor: ``visitor, rank, id, score``, scored like ``recommend``.

    ``profiles(visitor, performer, maker, series, genres)``.  What a profile adds to a work's score
    depends only on which terms agree.  Of the works that agree in one combination of terms only the
    first ``limit`` by their own score can be among a visitor's best, since those before them score as
    much at least.  So each combination keeps its head, a visitor meets the heads of its own
    combinations and the head of all works, and never the works.
    """
    w = K.RECOMMEND_WEIGHTS
    own = F.coalesce("popularity", F.lit(0)) * w["popularity"] + F.coalesce("favorite_count", F.lit(0)) * w["favorite_count"]
    slim = reuse(works.filter("is_published").select("id", *TERMS, own.alias("own")), "works")
    order: Order = [("own", "desc"), ("id", "asc")]
    subsets = [[t for i, t in enumerate(TERMS) if n >> i & 1] for n in range(1, 1 << len(TERMS))]
    # the values of a combination as one text; a missing value is in none
    named = lambda n, names, of: F.when(reduce(lambda a, b: a & b, [of(t).isNotNull() for t in names]), F.concat(F.lit(f"{n}:"), F.to_json(F.struct(*[of(t).alias(t) for t in names]))))
    keys = lambda of: F.array_compact(F.array(*[named(n, names, of) for n, names in enumerate(subsets)]))
    heads = top_within(slim.withColumn("key", F.explode(keys(F.col))), ["key"], order, limit, "_place").drop("_place")
    visitors = profiles.select("visitor", *TERMS[:3], "genres").withColumn("genre", F.explode_outer(F.array_distinct("genres")))
    terms = visitors.select("visitor", F.explode(keys(F.col)).alias("key")).distinct()
    met = terms.join(by_key(heads.select("key", "id")), "key").select("visitor", "id")
    first = F.broadcast(top_rows(slim, order, limit).select("id"))  # ``limit`` rows
    met = met.unionByName(profiles.select("visitor").distinct().crossJoin(first)).distinct()
    scored = met.join(by_key(slim), "id").join(by_key(profiles.select("visitor", *[F.col(t).alias(f"_{t}") for t in TERMS[:3]], F.col("genres").alias("_genres"))), "visitor")
    same = [F.when(F.col(t) == F.col(f"_{t}"), w[t]).otherwise(0) for t in TERMS[:3]]
    liked = F.when(F.coalesce(F.array_contains("_genres", F.col("genre")), F.lit(False)), w["genre"]).otherwise(0)
    scored = scored.select("visitor", "id", (F.col("own") + sum(same, liked)).cast("double").alias("score"))
    return top_within(scored, ["visitor"], [("score", "desc"), ("id", "asc")], limit).select("visitor", "rank", "id", "score")


def related_works(works: DataFrame, work_performers: DataFrame, limit: int = 8) -> DataFrame:
    """Related works of every published work: rows ``work_id, kind, rank, related_id``.

    A work's list is the most popular others that share a key, so each key needs only its
    first ``limit + 1`` works; the join then adds at most that many rows per work and key,
    however large the key's group is.
    """
    published = works.filter("is_published")
    slim = published.select("id", "popularity", "created_at", "maker", "series", "genre")
    order = [("popularity", "desc"), ("id", "asc")]
    lists = []
    cast = work_performers.select(F.col("work_id").alias("id"), F.col("performer_id").cast("string").alias("key")).distinct()
    by_performer = slim.join(cast, "id").select("id", "popularity", "created_at", "key")
    sources = [("performer", by_performer, order)]
    sources += [(kind, slim.filter(f"{kind} is not null").select("id", "popularity", "created_at", F.col(kind).alias("key")), order) for kind in ("maker", "series")]
    genre = slim.select("id", "popularity", "created_at", F.col("genre").alias("key"))
    sources.append(("genre", genre, [("popularity", "desc"), ("created_at", "desc"), ("id", "asc")]))
    for kind, rows, by in sources:
        heads = top_within(rows, ["key"], by, limit + 1, "_n").select(
            F.col("key"), F.col("id").alias("related_id"), F.col("popularity").alias("_p"), F.col("created_at").alias("_c")
        )
        # one row a key, so a work crosses once for each of its keys and not once for each pair
        packed = heads.groupBy("key").agg(F.collect_list(F.struct("related_id", "_p", "_c")).alias("_heads"))  # limit + 1 entries
        met = rows.select("id", "key").join(by_key(packed), "key").select(F.col("id").alias("work_id"), "_heads")
        names = {"popularity": "_p", "created_at": "_c", "id": "related_id"}
        pairs = met.repartition(partitions_of(works.sparkSession), "work_id").select("work_id", F.inline("_heads")).filter("work_id <> related_id")
        # pairs are gathered where their work is, so neither step below moves them
        ranked = top_within(pairs.distinct(), ["work_id"], [(names[c], d) for c, d in by], limit)
        lists.append(ranked.select("work_id", F.lit(kind).alias("kind"), "rank", "related_id"))
    # a work without a genre falls back to the most popular works of all
    bare = slim.filter("genre is null").select(F.col("id").alias("work_id"))
    best = top_rows(slim, [("popularity", "desc"), ("created_at", "desc"), ("id", "asc")], limit + 1)
    best = best.select(F.col("id").alias("related_id"), F.col("popularity").alias("_p"), F.col("created_at").alias("_c"))
    fallback = bare.join(F.broadcast(best), F.col("work_id") != F.col("related_id"))  # at most limit + 1 rows
    fallback = top_within(fallback, ["work_id"], [("_p", "desc"), ("_c", "desc"), ("related_id", "asc")], limit)
    lists.append(fallback.select("work_id", F.lit("genre").alias("kind"), "rank", "related_id"))
    return reduce(DataFrame.unionByName, lists)


def recently_viewed(views: DataFrame, n: int = 20) -> DataFrame:
    """Per session the last ``n`` distinct works, newest first."""
    last = views.groupBy("session_id", "work_id").agg(F.max("ts").alias("viewed_at"))
    return top_within(last, ["session_id"], [("viewed_at", "desc"), ("work_id", "asc")], n)


def work_cast(works: DataFrame, work_performers: DataFrame, performers: DataFrame) -> DataFrame:
    """Works with their performers, one row per billing place; works without cast keep one row.

    Rows rather than lists, so a work with a very long cast is never gathered in one place.
    """
    links = work_performers.join(performers, "performer_id").select(F.col("work_id").alias("id"), "position", F.col("name").alias("performer"))
    return works.join(links, "id", "left")


def interleave(primary: DataFrame, secondary: DataFrame, limit: int, start: int = 0) -> DataFrame:
    """Three primary rows, then one secondary; when one side runs out the other goes on.

    Both inputs carry ``position`` (0, 1, ...).  A row's slot follows from its own position:
    the order needs no loop.  ``start`` (0-3) continues a cycle begun on an earlier page.
    """
    limit = max(0, limit)
    i = F.col("position") + start
    a = primary.filter(F.col("position") < limit).withColumn("slot", F.floor(i / 3) * 4 + i % 3)
    b = secondary.filter(F.col("position") < limit).withColumn("slot", F.col("position") * 4 + 3)
    out = a.withColumn("side", F.lit("primary")).unionByName(b.withColumn("side", F.lit("secondary")), allowMissingColumns=True)
    return out.orderBy("slot", "side").limit(limit)


def entity_names(works: DataFrame, work_tags: DataFrame) -> DataFrame:
    """Distinct performer, maker, series, genre and tag names of published works, with page paths."""
    published = works.filter("is_published")
    kinds = ("performer", "maker", "series", "genre")
    names = published.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in kinds])))
    tags = work_tags.join(published, work_tags.work_id == published.id, "left_semi").select(F.lit("tag").alias("kind"), F.col("tag").alias("name"))
    rows = names.unionByName(tags).filter("name <> ''").distinct()
    encoded = F.replace(F.url_encode("name"), F.lit("+"), F.lit("%20"))
    return rows.withColumn("path", F.concat(F.lit("/"), "kind", F.lit("/"), encoded))


def sitemap_pages(works: DataFrame, site: str, page_size: int = K.SITEMAP_PAGE_SIZE) -> DataFrame:
    """``page, position, url, lastmod`` of every published work, in id order."""
    rows = works.filter("is_published").select("id", "product_code", "created_at")
    ranked = numbered(rows, [], [("id", "asc")], "position")
    return ranked.select(
        F.floor((F.col("position") - 1) / page_size).cast("bigint").alias("page"),
        "position",
        F.concat(F.lit(site + "/work/"), F.url_encode("product_code")).alias("url"),
        F.date_format("created_at", "yyyy-MM-dd").alias("lastmod"),
    )


def sitemap_plan(works: DataFrame, posts: DataFrame, page_size: int = K.SITEMAP_PAGE_SIZE) -> DataFrame:
    """Pages per source: at least one for works, none for an empty second source."""
    w = works.filter("is_published").agg(F.count("*").alias("n")).select(F.lit("works").alias("source"), F.greatest(F.lit(1), F.ceil(F.col("n") / page_size)).cast("bigint").alias("pages"))
    p = posts.agg(F.count("*").alias("n")).select(F.lit("posts").alias("source"), F.ceil(F.col("n") / page_size).cast("bigint").alias("pages"))
    return w.unionByName(p)
