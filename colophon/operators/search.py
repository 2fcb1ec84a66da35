"""Search and listing of published works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.functions.codes import code_key_lower, code_key_upper, hyphenate_code, name_key
from colophon.functions.text import clean_query, trigram_overlap, trigrams
from colophon.operators.ranking import Order, latest_per_key, order_by, top_rows

SORTS: dict[str, Order] = {
    "popular": [("popularity", "desc")],
    "new": [("created_at", "desc")],
    "release": [("release_date", "desc")],
}
CATALOG_SORTS: dict[str, Order] = {
    "popular": [("popularity", "desc"), ("created_at", "desc")],
    "new": [("created_at", "desc")],
    "newest": [("created_at", "desc")],
    "release": [("release_date", "desc")],
    "recommended": [("favorite_count", "desc"), ("popularity", "desc"), ("created_at", "desc")],
}
LISTING_SORTS: dict[str, Order] = {k: CATALOG_SORTS[k] for k in ("popular", "new", "release")}


def _any(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def contains_pattern(columns: list[str], query: str) -> Column:
    """Any column ``ILIKE %query%``; ``%`` and ``_`` in the query stay wildcards."""
    return _any([F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def alias_hits(aliases: DataFrame, query: str) -> DataFrame:
    """Canonical names with an alias that contains the query key.

    A query of punctuation only has an empty key and hits nothing (the reference would hit
    every alias).
    """
    key = name_key_of(query)
    if not key:
        return aliases.filter(F.lit(False)).select("canonical_name")
    return aliases.filter(name_key("alias").contains(key)).select("canonical_name").distinct()


def name_key_of(text: str) -> str:
    import re

    return re.sub(K.NAME_KEY_DROP, "", text or "").lower()


def search_works(
    works: DataFrame, aliases: DataFrame, query: str, sort: str = "popular", limit: int = 24, offset: int = 0
) -> DataFrame:
    """Ranked search over code, title, performer, maker, series and aliases.

    Direct matches are one scan with an OR filter; alias matches are three semi joins in
    form of flag joins, so a large alias table is shuffled rather than broadcast.
    Similarity is computed for matches only.
    """
    q = (query or "").strip()
    if not q:
        return works.filter(F.lit(False))
    code, name = "".join(ch for ch in q if ch.isascii() and ch.isalnum()).lower(), name_key_of(query)
    direct = [contains_pattern(["product_code", "title", "maker", "series"], q)]
    if code:
        direct.append(code_key_lower("product_code").contains(code))
    if name:
        direct.append(name_key("performer").contains(name))
    hits = alias_hits(aliases, query)
    found = works.filter("is_published").withColumn("_direct", _any(direct))
    for column in ("performer", "maker", "series"):
        flag = hits.select(F.col("canonical_name").alias(column), F.lit(True).alias(f"_{column}"))
        found = found.join(flag, column, "left")
    found = found.filter("_direct or _performer or _maker or _series")
    wanted = trigrams(F.lit(q))
    similarity = F.greatest(
        *[trigram_overlap(trigrams(c), wanted) for c in ("product_code", "title", "performer", "maker")]
    )
    exact = F.when(code_key_lower("product_code") == code, 0).otherwise(1) if code else F.lit(1)
    ordered = found.withColumn("_exact", exact).withColumn("similarity", F.round(similarity, 6))
    order: Order = [("_exact", "asc"), *SORTS.get(sort, SORTS["popular"]), ("similarity", "desc"), ("id", "asc")]
    return top_rows(ordered, order, limit, offset).select(*works.columns, "similarity")


def search_works_filtered(
    works: DataFrame, query: str = "", performer: str = "", maker: str = "", series: str = "",
    sort: str = "popular", limit: int = 24, offset: int = 0,
) -> DataFrame:
    """Search with field filters: every given filter must match."""
    out = works.filter("is_published")
    q = clean_query(query)
    if q:
        out = out.filter(contains_pattern(["product_code", "title"], q))
    for column, text in (("performer", performer), ("maker", maker), ("series", series)):
        if clean_query(text):
            out = out.filter(F.col(column).ilike(f"%{clean_query(text)}%"))
    order = [*LISTING_SORTS.get(sort, LISTING_SORTS["popular"]), ("id", "asc")]
    return top_rows(out, order, limit, offset)


def search_works_fallback(works: DataFrame, query: str, sort: str = "popular", limit: int = 24, offset: int = 0) -> DataFrame:
    """Plain pattern search, with a compact code also tried in hyphenated form."""
    import re

    q = clean_query(query)
    if not q:
        return works.filter(F.lit(False))
    compact = re.sub(r"[^a-zA-Z0-9]", "", q)
    match = re.fullmatch(r"([a-zA-Z]+)(\d+)", compact)
    hyphen = f"{match[1]}-{match[2]}" if match else q
    hit = contains_pattern(["product_code", "title", "performer", "maker", "series"], q) | contains_pattern(["product_code"], hyphen)
    order = [*LISTING_SORTS.get(sort, LISTING_SORTS["popular"]), ("id", "asc")]
    return top_rows(works.filter("is_published").filter(hit), order, limit, offset)


def work_by_code(works: DataFrame, codes: DataFrame) -> DataFrame:
    """Resolve many codes at once (``codes.code``): the work whose code has the same key.

    An exact spelling, or the hyphenated one, wins over another spelling of the same key.
    """
    wanted = codes.select("code", code_key_upper("code").alias("_key")).filter("_key is not null").distinct()
    known = works.filter("is_published").withColumn("_key", code_key_upper("product_code"))
    spelled = F.upper(F.trim("code"))
    exact = F.when(F.upper("product_code").isin(spelled, hyphenate_code(F.col("_key"))), 0).otherwise(1)
    pairs = wanted.join(known, "_key").withColumn("_exact", exact)
    return latest_per_key(pairs, ["code"], [("_exact", "asc"), ("id", "asc")]).drop("_key", "_exact")


def catalog_works(
    works: DataFrame, sort: str = "popular", genre: str | None = None, maker: str | None = None,
    limit: int = 24, offset: int = 0,
) -> DataFrame:
    out = works.filter("is_published")
    if genre:
        out = out.filter(F.col("genre") == genre)
    if maker:
        out = out.filter(F.col("maker") == maker)
    order = [*CATALOG_SORTS.get(sort, CATALOG_SORTS["popular"]), ("id", "asc")]
    return top_rows(out, order, limit, offset)


def _performer_filter(works: DataFrame, performer: str, query: str) -> DataFrame:
    out = works.filter(F.col("is_published") & (F.col("performer") == performer))
    q = (query or "").strip()
    return out.filter(contains_pattern(["product_code", "title", "maker", "series"], q)) if q else out


def performer_works(
    works: DataFrame, performer: str, query: str = "", sort: str = "popular", limit: int = 24, offset: int = 0
) -> DataFrame:
    first: dict[str, Order] = {
        "popular": [("popularity", "desc")], "release": [("release_date", "desc")], "maker": [("maker", "asc")],
    }
    order = [*first.get(sort, []), ("created_at", "desc"), ("id", "asc")]
    return top_rows(_performer_filter(works, performer, query), order, limit, offset)


def count_performer_works(works: DataFrame, performer: str, query: str = "") -> DataFrame:
    return _performer_filter(works, performer, query).agg(F.count("*").alias("work_count"))


def works_where(works: DataFrame, column: str, value: str, limit: int = 100) -> DataFrame:
    """Published works of one maker, series or genre, most popular first."""
    out = works.filter(F.col("is_published") & (F.col(column) == value))
    return top_rows(out, [("popularity", "desc"), ("id", "asc")], limit)


def tag_works(works: DataFrame, work_tags: DataFrame, tag: str, limit: int = 24, offset: int = 0) -> DataFrame:
    """A page of a tag's published works by id, shown by popularity."""
    links = work_tags.filter(F.col("tag") == tag).select("work_id")
    tagged = works.filter("is_published").join(links, works.id == links.work_id, "left_semi")
    return top_rows(tagged, [("id", "asc")], limit, offset).orderBy(*order_by([("popularity", "desc"), ("id", "asc")]))


def popular_tags(works: DataFrame, work_tags: DataFrame, limit: int = 30) -> DataFrame:
    """Names of the tags that published works carry, in name order."""
    published = works.filter("is_published").select("id")
    used = work_tags.join(published, work_tags.work_id == published.id, "left_semi").select("tag").distinct()
    return top_rows(used, [("tag", "asc")], limit)


def admin_works(works: DataFrame, query: str = "", page: int = 1) -> DataFrame:
    """Back-office page of 30 works, newest change first, each row with the exact total."""
    out = works
    q = (query or "").strip().replace(",", "")
    if q:
        out = out.filter(contains_pattern(["product_code", "title", "performer", "maker", "series"], q))
    total = out.agg(F.count("*").alias("n")).scalar()
    rows = top_rows(out, [("updated_at", "desc"), ("id", "asc")], K.ADMIN_PAGE_SIZE, (max(1, page) - 1) * K.ADMIN_PAGE_SIZE)
    return rows.withColumn("total", total)


def newest_works(works: DataFrame, limit: int = 8) -> DataFrame:
    return top_rows(works.filter("is_published"), [("created_at", "desc"), ("id", "asc")], limit)


def facet_counts(works: DataFrame, column: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Published works and popularity per maker or genre."""
    named = works.filter("is_published").filter(F.trim(column) != "")
    grouped = named.groupBy(F.col(column).alias("name")).agg(
        F.count("*").alias("work_count"), F.sum(F.coalesce("popularity", F.lit(0))).alias("popularity")
    )
    return top_rows(grouped, [("work_count", "desc"), ("name", "asc")], limit, offset)


def to_work_detail(works: DataFrame, image_hosts: tuple[str, ...]) -> DataFrame:
    """Public shape of works: rows without code or title drop out, texts are trimmed, links
    must be http(s), images must be on a trusted host, counters default to 0."""
    from colophon.functions.codes import blank_to_null
    from colophon.functions.urls import url_allowed, url_or_null

    def have(c: str) -> Column:
        return F.col(c) if c in works.columns else F.lit(None).cast("string")

    texts = ("performer", "maker", "series", "label", "genre", "description", "source_name", "external_product_id")
    links = ("video_url", "official_url", "affiliate_url")
    images = ("card_image_url", "image_url")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    created = have("created_at").cast("timestamp_ntz")
    out = works.select(
        F.coalesce(F.col("id").cast("string"), blank_to_null("product_code")).alias("id"),
        blank_to_null("product_code").alias("product_code"),
        blank_to_null("title").alias("title"),
        *[blank_to_null(have(c)).alias(c) for c in texts],
        *[url_or_null(have(c)).alias(c) for c in links],
        *[F.when(url_allowed(have(c), image_hosts), F.trim(have(c))).alias(c) for c in images],
        have("duration").try_cast("bigint").alias("duration"),
        F.coalesce(have("popularity").try_cast("bigint"), F.lit(0)).alias("popularity"),
        F.coalesce(have("favorite_count").try_cast("bigint"), F.lit(0)).alias("favorite_count"),
        have("release_date").cast("string").alias("release_date"),
        F.coalesce(created, epoch).alias("created_at"),
        F.coalesce(have("updated_at").cast("timestamp_ntz"), created, epoch).alias("updated_at"),
    )
    return out.filter("product_code is not null and title is not null")
