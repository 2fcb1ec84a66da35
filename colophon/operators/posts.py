"""Second source: approved projection, public rows, publication and review decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.functions.codes import blank_to_null
from colophon.functions.text import clean_query, forbidden_keys, unexpected_keys
from colophon.functions.urls import allowed_pattern, matches
from colophon.operators.ranking import keyset_page


@dataclass(frozen=True)
class PostSource:
    """Identity of the second source: its registered name and its hosts."""

    name: str
    host: str
    link_host: str
    badge: str
    currency: str = "JPY"

    def post_url(self, post_id: Column) -> Column:
        return F.concat(F.lit(f"https://{self.host}/posts/"), F.lower(post_id))

    def is_post_url(self, url, post_id) -> Column:
        """https, exact host, no user info, default port, no query or fragment, path of the id."""
        u, pid = F.col(url) if isinstance(url, str) else url, F.col(post_id) if isinstance(post_id, str) else post_id
        plain = matches(u, allowed_pattern((self.host,), subdomains=False, query=False, fragment=False))
        path = F.lower(F.regexp_extract(u, "(?i)^https://[^/?#]+([^?#]*)", 1))
        return plain & F.coalesce(pid.rlike(K.UUID_PATTERN), F.lit(False)) & F.coalesce(path == F.concat(F.lit("/posts/"), F.lower(pid)), F.lit(False))

    def link_ok(self, url) -> Column:
        """Tracking link: exact link host, https, and more than the bare root."""
        u = F.col(url) if isinstance(url, str) else url
        rule = allowed_pattern((self.link_host,), subdomains=False, fragment=False)
        bare = matches(u, "(?i)^https://[^/?#]+/?[?]?#?$")
        return matches(u, rule) & ~bare


def approved_posts(posts: DataFrame, creators: DataFrame, sources: DataFrame, source: PostSource) -> DataFrame:
    """Posts whose own and whose creator's review and visibility allow showing them.

    Both sides are filtered before the join, so only approvable rows are shuffled.
    """
    ok = lambda df: df.filter((F.col("review_state") == "approved") & F.col("visibility").isin(*K.PUBLIC_VISIBILITY))
    p = ok(posts).filter((F.trim("title") != "") & (F.lower("official_url") == source.post_url(F.col("external_post_id"))))
    c = ok(creators).filter(F.trim("display_name") != "").select(
        "creator_id", "data_source_id", "external_creator_id", F.col("profile_slug").alias("creator_slug"),
        F.col("display_name").alias("creator_name"), F.col("official_url").alias("creator_url"),
    )
    s = sources.filter((F.col("name") == source.name) & F.col("is_active")).select("data_source_id")
    j = p.join(s, "data_source_id", "left_semi").join(c, ["creator_id", "data_source_id"])
    tail = f"(?i)^https://([a-z0-9-]+[.])*{source.host.replace('.', '[.]')}([/?#]|$)"
    show = F.coalesce((F.col("link_status") == "active") & F.col("affiliate_url").rlike(tail) & ~F.col("affiliate_url").contains("@"), F.lit(False))
    return j.select(
        "external_post_id", "title", F.col("official_url").alias("canonical_url"), "price", "currency",
        F.coalesce("media_indicator", "content_type", F.lit("unknown")).alias("media_type"), "link_status", "affiliate_url",
        show.alias("show_affiliate_cta"), "external_creator_id", "creator_slug", "creator_name", "creator_url", F.lit(source.badge).alias("source_badge"),
    )


def search_posts(approved: DataFrame, query: str, after: str | None = None, limit: int = 24) -> DataFrame:
    """Title or creator pattern search with keyset paging on the post id; blank finds nothing."""
    import re

    q = re.sub(r"\s+", " ", clean_query(query)).strip()
    if not q:
        return approved.filter(F.lit(False))
    hits = approved.filter(F.col("title").ilike(f"%{q}%") | F.col("creator_name").ilike(f"%{q}%"))
    return list_posts(hits, after, limit)


def list_posts(approved: DataFrame, after: str | None = None, limit: int = 100) -> DataFrame:
    return keyset_page(approved, "external_post_id", after.lower() if after else None, limit)


def link_decision(status, url, source: PostSource) -> Column:
    """Struct ``show, url, reason`` of the tracking link."""
    active, good = F.coalesce(F.col(status) == "active", F.lit(False)), source.link_ok(url)
    return F.struct(
        (active & good).alias("show"), F.when(active & good, F.col(url)).alias("url"),
        F.when(~active, "status_not_active").when(~good, "active_url_invalid").otherwise("active_valid").alias("reason"),
    )


def public_posts(approved: DataFrame, source: PostSource) -> DataFrame:
    """Rows fit to show; a row with any invalid required field drops out."""
    texts = {c: blank_to_null(c) for c in ("external_post_id", "title", "creator_name", "creator_slug", "canonical_url")}
    rows = approved.withColumns(texts)
    ok = F.col("title").isNotNull() & F.col("creator_name").isNotNull() & F.col("creator_slug").isNotNull()
    ok = ok & (F.col("source_badge") == source.badge) & source.is_post_url("canonical_url", "external_post_id") & (F.col("currency") == source.currency)
    ok = ok & F.col("media_type").isin(*K.POST_MEDIA_TYPES) & F.col("link_status").isin(*K.LINK_STATES)
    price = F.col("price").try_cast("decimal(20,4)")
    whole = (price >= 0) & (price == F.floor(price)) & (price <= K.MAX_SAFE_INTEGER)
    link = link_decision("link_status", "affiliate_url", source)
    return rows.filter(ok).select(
        F.lower("external_post_id").alias("external_post_id"), F.concat(F.lit("/work/post/"), F.lower("external_post_id")).alias("path"), "title", "creator_name",
        "creator_slug", F.when(whole, price).cast("bigint").alias("price"), "currency", "media_type", "canonical_url", "link_status",
        link["url"].alias("affiliate_url"), link["show"].alias("show_affiliate_cta"),
    )


def publication_decisions(rows: DataFrame, source: PostSource) -> DataFrame:
    """Block reasons, eligibility, canonical URL and link decision per post.

    ``rows``: ``source_name, external_post_id, title, canonical_url, creator_relation_valid,
    creator_visibility, creator_review_state, post_visibility, post_review_state,
    link_status, affiliate_url, prohibited_fields``.
    """
    visible = lambda c: F.coalesce(F.col(c).isin(*K.PUBLIC_VISIBILITY), F.lit(False))
    approved = lambda c: F.coalesce(F.col(c) == "approved", F.lit(False))
    host_ok = matches("canonical_url", allowed_pattern((source.host,), subdomains=False))
    exact = source.is_post_url("canonical_url", "external_post_id")
    blocks = F.array_compact(
        F.array(
            F.when(~F.col("source_name").eqNullSafe(F.lit(source.name)), "source_not_registered"),
            F.when(~visible("creator_visibility"), "creator_visibility_not_approved"),
            F.when(~approved("creator_review_state"), "creator_review_not_approved"),
            F.when(~visible("post_visibility"), "post_visibility_not_approved"),
            F.when(~approved("post_review_state"), "post_review_not_approved"),
            F.when(blank_to_null("title").isNull(), "title_missing"),
            F.when(~F.coalesce(F.col("external_post_id").rlike(K.UUID_PATTERN), F.lit(False)), "external_post_id_invalid"),
            F.when(~host_ok, "canonical_url_invalid").when(~exact, "canonical_url_identity_mismatch"),
            F.when(~F.coalesce(F.col("creator_relation_valid"), F.lit(False)), "creator_relation_invalid"),
            F.when(F.size("prohibited_fields") > 0, "prohibited_private_fields_present"),
        )
    )
    out = rows.withColumn("block_reasons", blocks)
    return out.withColumns(
        {"eligible": F.size("block_reasons") == 0, "canonical_outbound_url": F.when(exact, F.col("canonical_url")), "link": link_decision("link_status", "affiliate_url", source)}
    )


def preview_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("total"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("blocked"),
        F.count_if(F.col("link.show")).alias("affiliate_cta_visible"), F.count("*").alias("neutral_placeholders"),
    )


@dataclass(frozen=True)
class ReviewContext:
    registered_media_approved: bool = True
    text_only: str = "allowed"  # allowed | unknown | denied
    approved_only: str = "allowed"

    def reject(self) -> list[str]:
        return [c for c, v in (("TEXT_ONLY_PUBLICATION_DENIED", self.text_only), ("APPROVED_ONLY_PUBLICATION_DENIED", self.approved_only)) if v == "denied"]

    def review(self) -> list[str]:
        out = [] if self.registered_media_approved else ["REGISTERED_MEDIA_APPROVAL_UNCONFIRMED"]
        pairs = (("TEXT_ONLY_PUBLICATION_PERMISSION_UNKNOWN", self.text_only), ("APPROVED_ONLY_PUBLICATION_PERMISSION_UNKNOWN", self.approved_only))
        return out + [c for c, v in pairs if v == "unknown"]


def _reasons(fixed: list[str], *flags: tuple[Column, str]) -> Column:
    return F.array_compact(F.concat(F.array(*[F.lit(x) for x in fixed]).cast("array<string>"), F.array(*[F.when(c, code) for c, code in flags])))


def _verdict(df: DataFrame, satisfied: str) -> DataFrame:
    """Reject beats review beats auto-approve; ``_evidence`` is appended to the reasons."""
    clean = (F.size("_reject") == 0) & (F.size("_review") == 0)
    label = F.when(F.size("_reject") > 0, "REJECT").when(F.size("_review") > 0, "NEEDS_HUMAN_REVIEW").otherwise("AUTO_APPROVABLE")
    first = F.when(clean, F.array(F.lit(satisfied))).otherwise(F.array().cast("array<string>"))
    codes = F.array_distinct(F.concat("_reject", "_review", first, "_evidence"))
    return df.withColumn("classification", label).withColumn("reason_codes", codes)


def _copies(df: DataFrame, column: str) -> DataFrame:
    """Flag rows whose value of ``column`` occurs more than once (nulls never do)."""
    many = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).filter("_n > 1").select(column, F.lit(True).alias(f"_dup_{column}"))
    return df.join(many, column, "left")


def classify_creators(creators: DataFrame, posts: DataFrame, source: PostSource, context: ReviewContext = ReviewContext()) -> DataFrame:
    """``creators(creator_id, data_source_id, source_name, external_creator_id, profile_slug,
    display_name, official_url, metadata, has_media)``; ``posts(creator_id, data_source_id)``."""
    linked = posts.groupBy("creator_id", "data_source_id").agg(F.count("*").alias("_here"))
    totals = linked.groupBy("creator_id").agg(F.sum("_here").alias("_all"))
    c = creators
    for column in ("external_creator_id", "profile_slug", "official_url"):
        c = _copies(c, column)
    c = c.join(linked, ["creator_id", "data_source_id"], "left").join(totals, "creator_id", "left").fillna(0, ["_here", "_all"])
    slug_ok = F.coalesce(F.col("profile_slug").rlike(K.SLUG_PATTERN), F.lit(False))
    identity = slug_ok & F.col("external_creator_id").eqNullSafe(F.concat(F.lit("profile_slug:"), F.lower("profile_slug")))
    conflict = ~F.coalesce(F.col("external_creator_id") == F.concat(F.lit("profile_slug:"), F.lower("profile_slug")), F.lit(False))
    path = F.regexp_replace(F.lower(F.regexp_extract("official_url", "(?i)^https://[^/?#]+([^?#]*)", 1)), "^/+|/+$", "")
    profile = slug_ok & matches("official_url", allowed_pattern((source.host,), subdomains=False, query=False, fragment=False)) & (path == F.lower("profile_slug"))
    duplicate = F.coalesce("_dup_external_creator_id", "_dup_profile_slug", "_dup_official_url", F.lit(False))
    rejects = _reasons(
        context.reject(),
        (~F.col("source_name").eqNullSafe(F.lit(source.name)), "SOURCE_NOT_REGISTERED"), (duplicate, "DUPLICATE_CREATOR_IDENTITY"),
        (conflict, "CREATOR_IDENTITY_CONFLICT"), (~identity, "CREATOR_STABLE_IDENTITY_INVALID"),
        (blank_to_null("display_name").isNull(), "CREATOR_NAME_MISSING"), (~profile, "CREATOR_CANONICAL_PROFILE_MISMATCH"),
        (F.size(forbidden_keys("metadata")) > 0, "PROHIBITED_PRIVATE_DATA_PRESENT"), (F.col("_all") > F.col("_here"), "CREATOR_POST_RELATION_CONFLICT"),
    )
    reviews = _reasons(
        context.review(),
        (F.size(unexpected_keys("metadata")) > 0, "UNEXPECTED_METADATA_REQUIRES_REVIEW"), (F.col("has_media"), "RIGHTS_DEPENDENT_MEDIA_PRESENT"),
        (F.col("_all") < 1, "CREATOR_HAS_NO_LINKED_POSTS"),
    )
    out = c.withColumns({"_reject": rejects, "_review": reviews, "_evidence": F.array().cast("array<string>")})
    return _verdict(out, "TEXT_ONLY_CREATOR_CONTRACT_SATISFIED").select(*creators.columns, "classification", "reason_codes")


def classify_posts(posts: DataFrame, classified: DataFrame, source: PostSource, context: ReviewContext = ReviewContext()) -> DataFrame:
    """Posts judged with their creator's result.

    ``posts(post_id, data_source_id, creator_id, source_name, external_post_id, title,
    official_url, media_type, price, currency, metadata, has_media, link_status, affiliate_url)``.
    """
    p = _copies(_copies(posts, "external_post_id"), "official_url")
    c = classified.select("creator_id", F.col("data_source_id").alias("_source"), F.col("classification").alias("_creator"))
    j = p.join(c, "creator_id", "left")
    exact = F.coalesce(F.col("_source") == F.col("data_source_id"), F.lit(False))
    price = F.col("price").try_cast("decimal(20,4)")
    bad_price = F.col("price").isNotNull() & ~F.coalesce((price >= 0) & (price == F.floor(price)), F.lit(False))
    rejects = _reasons(
        context.reject(),
        (~F.col("source_name").eqNullSafe(F.lit(source.name)), "SOURCE_NOT_REGISTERED"),
        (F.coalesce("_dup_external_post_id", "_dup_official_url", F.lit(False)), "DUPLICATE_POST_IDENTITY"),
        (~source.is_post_url("official_url", "external_post_id"), "POST_CANONICAL_IDENTITY_INVALID"),
        (blank_to_null("title").isNull(), "POST_TITLE_MISSING"), (~exact, "POST_CREATOR_RELATION_CONFLICT"),
        (F.col("_creator").isNull() | (F.col("_creator") == "REJECT"), "CREATOR_REJECTED"),
        (F.size(forbidden_keys("metadata")) > 0, "PROHIBITED_PRIVATE_DATA_PRESENT"),
        (~F.coalesce(F.col("media_type").isin(*K.POST_MEDIA_TYPES), F.lit(False)), "POST_MEDIA_TYPE_INVALID"),
        (bad_price, "POST_PRICE_INVALID"), (~F.col("currency").eqNullSafe(F.lit(source.currency)), "POST_CURRENCY_INVALID"),
    )
    reviews = _reasons(
        context.review(), (F.col("_creator") == "NEEDS_HUMAN_REVIEW", "CREATOR_REVIEW_DEPENDENCY"),
        (F.size(unexpected_keys("metadata")) > 0, "UNEXPECTED_METADATA_REQUIRES_REVIEW"), (F.col("has_media"), "RIGHTS_DEPENDENT_MEDIA_PRESENT"),
    )
    evidence = _reasons(
        [], (F.col("price").isNull(), "OPTIONAL_PRICE_MISSING"), (F.col("media_type") == "unknown", "OPTIONAL_MEDIA_TYPE_UNKNOWN"),
        ((F.col("link_status") == "missing") & F.col("affiliate_url").isNull(), "AFFILIATE_LINK_MISSING_NON_BLOCKING"),
    )
    out = j.withColumns({"_reject": rejects, "_review": reviews, "_evidence": evidence, "creator_relation_valid": exact, "prohibited_fields": forbidden_keys("metadata")})
    return _verdict(out, "TEXT_ONLY_POST_CONTRACT_SATISFIED").select(*posts.columns, "creator_relation_valid", "prohibited_fields", "classification", "reason_codes")


def simulate_approval(classified_posts: DataFrame, source: PostSource) -> DataFrame:
    """Counts if every auto-approvable post and its creator were approved now."""
    auto = F.col("classification") == "AUTO_APPROVABLE"
    state = {
        "creator_visibility": F.lit("affiliate_visible"), "creator_review_state": F.lit("approved"),
        "post_visibility": F.lit("affiliate_visible"), "post_review_state": F.lit("approved"), "canonical_url": F.col("official_url"),
    }
    decided = publication_decisions(classified_posts.withColumns(state), source)
    good = auto & F.col("eligible")
    return decided.agg(
        F.count_if(good).alias("eligible_posts"), F.count_if(~good).alias("blocked_posts"), F.count_if(auto & F.col("link.show")).alias("affiliate_cta_count"),
        F.count_if(auto).alias("placeholder_count"), F.count_if(good).alias("projection_candidates"),
    )
