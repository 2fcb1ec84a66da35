"""Collector bundles: validation, identity resolution, cumulative merge and incremental diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.functions.codes import blank_to_null
from colophon.functions.hashing import metadata_hash
from colophon.operators.greedy import first_come
from colophon.operators.merging import changed_fields
from colophon.operators.posts import PostSource
from colophon.operators.ranking import top_rows
from colophon.session import reuse

# fixed values: closed sets of the bundle contract
PARSER_CONFIDENCE = ("HIGH", "MEDIUM", "LOW")
BUNDLE_MEDIA = ("video", "image", "unknown")
POST_VALUES = ("title", "price", "reward_rate", "estimated_reward", "media_type", "duration_seconds", "likes", "eligible", "affiliate_url")


def normalize_bundle_posts(posts: DataFrame, source: PostSource) -> DataFrame:
    """Typed post rows with ``reasons`` against each, before duplicates are looked at.

    ``posts(index, post_uuid, post_public_url, title, creator_name, creator_username,
    creator_profile_url, price, reward_rate, estimated_reward, media_type, duration_seconds,
    likes, eligible, displayed_affiliate_url, affiliate_link_status, parser_confidence,
    collected_at)``.
    """
    uuid = F.lower(F.trim("post_uuid"))
    profile = F.regexp_extract("creator_profile_url", f"(?i)^https://(?:www[.])?{source.host.replace('.', '[.]')}/([^/?#]+)/?$", 1)
    has_profile = F.col("creator_profile_url").isNotNull()
    name = F.coalesce(blank_to_null("creator_username"), F.nullif(profile, F.lit("")))
    no_identity = blank_to_null("creator_username").isNull() & ~has_profile
    bad_profile = has_profile & (profile == "")
    bad_name = ~F.coalesce(name.rlike(K.SLUG_PATTERN), F.lit(False))
    differs = has_profile & (profile != "") & ~F.lower(name).eqNullSafe(F.lower(profile))
    link = F.nullif(F.col("displayed_affiliate_url"), F.lit(""))
    good_link = source.link_ok("displayed_affiliate_url")
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(False)) | F.coalesce(F.col(c) > K.MAX_SAFE_INTEGER, F.lit(False))
    rate, reward, price = F.col("reward_rate"), F.col("estimated_reward"), F.col("price")
    same_url = source.is_post_url(F.regexp_replace("post_public_url", "(?i)^https://www[.]", "https://"), uuid)
    yes = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~yes(uuid.rlike(K.SESSION_PATTERN)), "INVALID_OR_MISSING_POST_UUID").when(~same_url, "MALFORMED_OR_MISMATCHED_POST_PUBLIC_URL"),
            F.when(no_identity, "MISSING_CREATOR_IDENTITY").when(bad_profile, "MALFORMED_CREATOR_PROFILE_URL").when(bad_name, "MALFORMED_CREATOR_IDENTITY")
            .when(differs, "CONFLICTING_CREATOR_IDENTITY").when(blank_to_null("creator_name").isNull(), "MISSING_CREATOR_DISPLAY_NAME"),
            F.when(F.col("collected_at").try_cast("timestamp_ntz").isNull(), "INVALID_COLLECTED_AT"),
            F.when(~yes(F.col("parser_confidence").isin(*PARSER_CONFIDENCE)), "INVALID_PARSER_CONFIDENCE"),
            F.when(~yes(F.col("media_type").isin(*BUNDLE_MEDIA)), "INVALID_MEDIA_TYPE"),
            F.when(F.col("eligible").isNull(), "INVALID_AFFILIATE_ELIGIBILITY"),
            F.when(bad("price"), "INVALID_PRICE_JPY"), F.when(bad("estimated_reward"), "INVALID_ESTIMATED_REWARD_JPY"),
            F.when(yes((rate < 0) | (rate > 100)), "INVALID_AFFILIATE_REWARD_RATE"), F.when(bad("likes"), "INVALID_LIKES"), F.when(bad("duration_seconds"), "INVALID_VIDEO_DURATION_SECONDS"),
            F.when(link.isNotNull() & ~good_link, "INVALID_AFFILIATE_URL"),
            F.when(F.col("affiliate_link_status").isNotNull() & ~F.col("affiliate_link_status").isin("ACTIVE", "active"), "INVALID_AFFILIATE_LINK_STATUS"),
            F.when(F.col("affiliate_link_status").isNotNull() & ~(link.isNotNull() & good_link), "ACTIVE_AFFILIATE_URL_MISSING"),
            F.when(reward.isNotNull() & price.isNull(), "ESTIMATED_REWARD_WITHOUT_PRICE"), F.when(yes(reward > price), "ESTIMATED_REWARD_EXCEEDS_PRICE"),
            F.when(yes(reward > price * rate / 100 + 1), "ESTIMATED_REWARD_EXCEEDS_GROSS_RATE"),
            F.when(F.col("title").isNotNull() & (F.trim("title") == ""), "EMPTY_TITLE"),
        )
    )
    return posts.withColumn("reasons", reasons).select(
        "index", uuid.alias("external_post_id"), source.post_url(uuid).alias("official_url"), F.trim("title").alias("title"),
        name.alias("profile_slug"), F.concat(F.lit("profile_slug:"), F.lower(name)).alias("external_creator_id"), blank_to_null("creator_name").alias("display_name"),
        F.concat(F.lit(f"https://{source.host}/"), name).alias("creator_url"), "price", "reward_rate", "estimated_reward", "media_type", "duration_seconds", "likes",
        "eligible", F.when(good_link, link).alias("affiliate_url"), "collected_at", "reasons",
    )


def import_bundle(posts: DataFrame, source: PostSource) -> DataFrame:
    """Outcome per post: accepted, rejected (with reasons), skipped or duplicate.

    The first post of an id counts; a later one with the same values is skipped, one with
    other values is rejected.  A creator's first name counts; posts that name the creator
    differently are rejected.
    """
    rows = normalize_bundle_posts(posts, source)
    hashed = reuse(rows.withColumn("_hash", metadata_hash("external_post_id", "external_creator_id", "display_name", *POST_VALUES)))
    valid = hashed.filter((F.size("reasons") == 0) & F.col("eligible"))
    names = valid.groupBy("external_creator_id").agg(F.min_by("display_name", "index").alias("_name"))
    agreeing = valid.join(names, "external_creator_id").filter("display_name = _name")
    first = agreeing.groupBy("external_post_id").agg(F.min("index").alias("_first"), F.min_by("_hash", "index").alias("_first_hash"))
    j = hashed.join(names, "external_creator_id", "left").join(first, "external_post_id", "left")
    later = F.coalesce(F.col("_first") < F.col("index"), F.lit(False))
    outcome = (
        F.when(F.size("reasons") > 0, "rejected").when(~F.col("eligible"), "skipped")
        .when(later & (F.col("_hash") == F.col("_first_hash")), "duplicate").when(later, "rejected")
        .when(~F.col("display_name").eqNullSafe(F.col("_name")), "rejected").otherwise("accepted")
    )
    late_reason = (
        F.when(F.size("reasons") > 0, F.col("reasons")).when(~F.col("eligible"), F.array(F.lit("AFFILIATE_INELIGIBLE")))
        .when(later & (F.col("_hash") != F.col("_first_hash")), F.array(F.lit("DUPLICATE_CONFLICTING_UUID")))
        .when(~later & ~F.col("display_name").eqNullSafe(F.col("_name")), F.array(F.lit("CONFLICTING_CREATOR_DISPLAY_NAME")))
        .otherwise(F.array().cast("array<string>"))
    )
    return j.withColumns({"outcome": outcome, "reasons": late_reason}).withColumnRenamed("_hash", "source_hash").select(*rows.columns, "outcome", "source_hash")


def bundle_targets(imported: DataFrame) -> dict[str, DataFrame]:
    """Creator and post rows to resolve, from the accepted posts."""
    ok = reuse(imported.filter("outcome = 'accepted'"))
    creators = ok.groupBy("external_creator_id").agg(
        F.min_by("profile_slug", "index").alias("profile_slug"), F.min_by("display_name", "index").alias("display_name"),
        F.min_by("creator_url", "index").alias("official_url"), F.max("collected_at").alias("fetched_at"), F.count("*").alias("post_count"),
    )
    posts = ok.select(
        "external_post_id", "external_creator_id", "title", "official_url", F.col("media_type").alias("content_type"), F.col("media_type").alias("media_indicator"), "price",
        F.lit("JPY").alias("currency"), F.when(F.col("affiliate_url").isNotNull(), "active").otherwise("missing").alias("link_status"), "affiliate_url", F.col("collected_at").alias("fetched_at"),
    )
    return {"creators": reuse(creators), "posts": posts}


def import_report(imported: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("outcome") == v)
    return imported.agg(
        F.count("*").alias("input"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), (n("skipped") + n("duplicate")).alias("skipped"), n("duplicate").alias("duplicate_identical"),
        F.count_if(F.array_contains("reasons", "DUPLICATE_CONFLICTING_UUID")).alias("duplicate_conflicting"),
    )


CREATOR_FIELDS = ("profile_slug", "display_name", "official_url")
RESOLVED_POST_FIELDS = ("title", "official_url", "content_type", "media_indicator", "price", "currency")


def _plain_url(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "^(https://)(www[.])?([^?#]*?)/?([?#].*)?$", "$1$3")


def resolve_creators(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """NEW, EXISTING_EXACT (with changed fields), CONFLICT or AMBIGUOUS per target creator.

    Matching by id, by slug and by profile URL are three equi-joins; what they find is
    collected per target as a count of distinct rows and the lowest one.
    """
    t = targets.select("external_creator_id", F.struct(*CREATOR_FIELDS).alias("target"))
    e = existing.select(F.col("creator_id").alias("id"), F.struct("external_creator_id", *CREATOR_FIELDS).alias("row"))
    keys = (
        ("EXTERNAL_CREATOR_ID", F.col("external_creator_id"), F.col("row.external_creator_id")),
        ("PROFILE_SLUG", F.lower(F.trim("target.profile_slug")), F.lower(F.trim("row.profile_slug"))),
        ("CANONICAL_PROFILE_URL", _plain_url(F.col("target.official_url")), _plain_url(F.col("row.official_url"))),
    )
    found = []
    for basis, left, right in keys:
        a = t.select("external_creator_id", left.alias("_k")).filter("_k <> ''")
        b = e.select("id", "row", right.alias("_k")).filter("_k <> ''")
        found.append(a.join(b, "_k").select("external_creator_id", "id", "row", F.lit(basis).alias("basis")))
    matches = reduce(DataFrame.unionByName, found).groupBy("external_creator_id").agg(
        F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.min_by("row", "id").alias("row"), F.array_sort(F.collect_set("basis")).alias("match_basis")
    )
    j = t.join(matches, "external_creator_id", "left")
    slug, url = F.lower(F.trim("row.profile_slug")), _plain_url(F.col("row.official_url"))
    conflicts = F.array_compact(
        F.array(
            F.when((slug != "") & (slug != F.lower(F.trim("target.profile_slug"))), "PROFILE_SLUG_MISMATCH"),
            F.when((url != "") & (url != _plain_url(F.col("target.official_url"))), "PROFILE_URL_MISMATCH"),
            F.when(F.col("row.external_creator_id").startswith("profile_slug:") & (F.col("row.external_creator_id") != F.col("external_creator_id")), "FALLBACK_EXTERNAL_ID_MISMATCH"),
        )
    )
    none = F.array().cast("array<string>")
    status = (
        F.when(F.col("_lo").isNull(), "NEW").when(F.col("_lo") != F.col("_hi"), "AMBIGUOUS").when(F.size("conflict_reasons") > 0, "CONFLICT").otherwise("EXISTING_EXACT")
    )
    j = j.withColumn("conflict_reasons", F.when((F.col("_lo") == F.col("_hi")), conflicts).otherwise(none)).withColumn("status", status)
    j = j.withColumn("changed_fields", F.when(F.col("status") == "EXISTING_EXACT", changed_fields(list(CREATOR_FIELDS), "row", "target")).otherwise(none))
    action = F.when(F.col("status") == "NEW", "INSERT").when(F.col("status") != "EXISTING_EXACT", "BLOCK").when(F.size("changed_fields") > 0, "UPDATE").otherwise("NO_OP")
    return j.select(
        "external_creator_id", "status", F.coalesce("match_basis", none).alias("match_basis"), "conflict_reasons", "changed_fields", action.alias("planned_action"),
        F.when(F.col("status") == "EXISTING_EXACT", F.col("_lo")).alias("creator_id"),
    )


def resolve_posts(targets: DataFrame, existing: DataFrame, creators: DataFrame) -> DataFrame:
    """NEW, EXISTING_IDENTICAL, EXISTING_UPDATE_NEEDED or CONFLICT per target post."""
    row = F.struct("creator_id", *RESOLVED_POST_FIELDS)
    e = existing.groupBy("external_post_id").agg(F.count("*").alias("_n"), F.min(row).alias("row"))
    c = creators.select("external_creator_id", F.col("status").alias("_cs"), F.col("creator_id").alias("_cid"))
    j = targets.select("external_post_id", "external_creator_id", F.struct(*RESOLVED_POST_FIELDS).alias("target")).join(c, "external_creator_id", "left").join(e, "external_post_id", "left")
    unresolved = F.col("_cs").isNull() | F.col("_cs").isin("AMBIGUOUS", "CONFLICT")
    relation = (F.col("_cs") == "NEW") | ~F.col("row.creator_id").eqNullSafe(F.col("_cid"))
    url = ~F.coalesce(_plain_url(F.col("row.official_url")) == _plain_url(F.col("target.official_url")), F.lit(False))
    reasons = (
        F.when(unresolved, F.array(F.lit("CREATOR_IDENTITY_UNRESOLVED"))).when(F.col("_n") > 1, F.array(F.lit("MULTIPLE_ROWS_FOR_POST_UUID")))
        .when(F.col("_n") == 1, F.array_compact(F.array(F.when(relation, "CREATOR_RELATION_MISMATCH"), F.when(url, "POST_URL_MISMATCH"))))
        .otherwise(F.array().cast("array<string>"))
    )
    j = j.withColumn("conflict_reasons", reasons)
    j = j.withColumn("changed_fields", F.when((F.size("conflict_reasons") == 0) & (F.col("_n") == 1), changed_fields(list(RESOLVED_POST_FIELDS), "row", "target")).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.size("conflict_reasons") > 0, "CONFLICT").when(F.col("_n").isNull(), "NEW").when(F.size("changed_fields") > 0, "EXISTING_UPDATE_NEEDED").otherwise("EXISTING_IDENTICAL")
    )
    return j.select("external_post_id", status.alias("status"), "conflict_reasons", "changed_fields", "_cid").withColumnRenamed("_cid", "creator_id")


def resolve_identities(targets: dict[str, DataFrame], creators: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = reuse(resolve_creators(targets["creators"], creators))
    return c, resolve_posts(targets["posts"], posts, c)


def apply_resolution(targets: dict[str, DataFrame], resolved: tuple[DataFrame, DataFrame], creators: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored creators and posts after the planned inserts and updates; blocked rows change nothing."""
    rc, rp = resolved
    new_id = F.abs(F.xxhash64("external_creator_id"))
    planned = targets["creators"].join(rc.filter("planned_action in ('INSERT','UPDATE')").select("external_creator_id", "creator_id"), "external_creator_id")
    rows = planned.select(F.coalesce("creator_id", new_id).alias("creator_id"), "external_creator_id", *CREATOR_FIELDS)
    next_creators = creators.select(*rows.columns).join(rows.select("creator_id"), "creator_id", "left_anti").unionByName(rows)
    ok = rp.filter("status in ('NEW','EXISTING_UPDATE_NEEDED')").select("external_post_id", F.col("creator_id").alias("_cid"))
    p = targets["posts"].join(ok, "external_post_id").select("external_post_id", F.coalesce("_cid", new_id).alias("creator_id"), *RESOLVED_POST_FIELDS)
    next_posts = posts.select(*p.columns).join(p.select("external_post_id"), "external_post_id", "left_anti").unionByName(p)
    return next_creators, next_posts


def second_run_changes(targets: dict[str, DataFrame], creators: DataFrame, posts: DataFrame) -> DataFrame:
    """Idempotency check: what a second run would still insert or update (zero rows is right)."""
    first = resolve_identities(targets, creators, posts)
    next_creators, next_posts = apply_resolution(targets, (first[0], reuse(first[1])), creators, posts)
    c2, p2 = resolve_identities(targets, reuse(next_creators), reuse(next_posts))
    a = c2.filter("planned_action in ('INSERT','UPDATE')").select(F.col("external_creator_id").alias("identity"), "status")
    return a.unionByName(p2.filter("status in ('NEW','EXISTING_UPDATE_NEEDED')").select(F.col("external_post_id").alias("identity"), "status"))


def resolve_link_import(observed: DataFrame, existing: DataFrame, source: PostSource) -> DataFrame:
    """ACTIVE_NEW, ACTIVE_IDENTICAL, CONFLICT or INVALID per observed link.

    ``observed(position, post_uuid, displayed_affiliate_url)``.  The first valid link of a
    post counts; a later different one is a conflict.  Rows without any link are left out.
    """
    uuid, url = F.lower(F.coalesce("post_uuid", F.lit(""))), F.nullif(F.trim("displayed_affiliate_url"), F.lit(""))
    rows = observed.select("position", uuid.alias("post_uuid"), url.alias("url"), F.col("displayed_affiliate_url").alias("_shown"))
    rows = rows.withColumn("_ok", F.coalesce(F.col("post_uuid").rlike(K.SESSION_PATTERN), F.lit(False)) & source.link_ok("url"))
    rows = rows.filter(F.col("_ok") | (F.coalesce(F.col("_shown"), F.lit("")) != ""))
    first = rows.filter("_ok").groupBy("post_uuid").agg(F.min_by("url", "position").alias("_first"))
    e = existing.groupBy(F.lower("external_post_id").alias("post_uuid")).agg(F.max(F.struct(F.lower(F.coalesce("link_status", F.lit("missing"))).alias("s"), F.col("affiliate_url").alias("u"))).alias("_row"))
    j = rows.join(first, "post_uuid", "left").join(e, "post_uuid", "left")
    status = (
        F.when(~F.col("_ok"), "INVALID").when(F.col("url") != F.col("_first"), "CONFLICT").when(F.col("_row").isNull(), "INVALID")
        .when((F.col("_row.s") == "active") & F.trim("_row.u").eqNullSafe(F.col("url")), "ACTIVE_IDENTICAL")
        .when((F.col("_row.s") == "missing") & (F.coalesce("_row.u", F.lit("")) == ""), "ACTIVE_NEW").otherwise("CONFLICT")
    )
    return j.select("position", "post_uuid", status.alias("status"), F.when(F.col("_ok"), F.col("url")).alias("affiliate_url"))


def link_import_summary(items: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("status") == v)
    out = items.agg(*[n(s).alias(s.lower()) for s in ("ACTIVE_NEW", "ACTIVE_IDENTICAL", "CONFLICT", "INVALID")])
    return out.withColumn("safe_to_apply", (F.col("conflict") == 0) & (F.col("invalid") == 0))


def merge_cumulative(existing: DataFrame, run: DataFrame, key: str, fields: list[str], identity: list[str], run_id: str, sticky: str | None = None, keep_old: bool = False) -> dict[str, DataFrame]:
    """Fold one collection run into the cumulative records.

    ``existing`` carries the fields plus ``first_seen_at, first_seen_run, last_seen_at,
    last_seen_run``; ``run`` has one row per key with ``collected_at``.  Identity fields that
    contradict go to ``conflicts`` and change nothing.  ``keep_old``: an observed null or
    blank never overwrites.  ``sticky``: a link, once seen, stays, and another one is a
    conflict.  Records missing from the run stay.
    """
    o = existing.select(F.col(key), F.struct(*fields, "first_seen_at", "first_seen_run", "last_seen_at", "last_seen_run").alias("old"))
    n = run.select(F.col(key), F.struct(*fields, "collected_at").alias("new"))
    j = o.join(n, key, "full_outer")
    clash: Column = F.lit(False)
    for f in [*identity, *([sticky] if sticky else [])]:
        clash = clash | F.coalesce(F.col(f"old.{f}") != F.col(f"new.{f}"), F.lit(False))
    j = j.withColumn("_clash", clash & F.col("new").isNotNull())
    seen = F.col("new").isNotNull() & ~F.col("_clash")

    def merged(f: str) -> Column:
        new = F.col(f"new.{f}")
        if keep_old or f == sticky:
            new = F.coalesce(F.nullif(new, F.lit("")) if dict(run.dtypes)[f] == "string" else new, F.col(f"old.{f}"))
        return F.when(seen, new).otherwise(F.col(f"old.{f}")).alias(f)

    j = j.withColumn("merged", F.struct(*[merged(f) for f in fields]))
    same = F.struct(*[F.col(f"old.{f}").alias(f) for f in fields]).eqNullSafe(F.col("merged"))
    status = F.when(F.col("_clash"), "conflict").when(F.col("new").isNull(), "absent").when(F.col("old").isNull(), "added").when(same, "unchanged").otherwise("updated")
    j = j.withColumn("status", status)
    at = F.col("new.collected_at")
    records = j.filter("old is not null or not _clash").select(
        key, *[F.col(f"merged.{f}").alias(f) for f in fields],
        F.coalesce("old.first_seen_at", at).alias("first_seen_at"), F.coalesce("old.first_seen_run", F.lit(run_id)).alias("first_seen_run"),
        F.when(seen, at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"), F.when(seen, F.lit(run_id)).otherwise(F.col("old.last_seen_run")).alias("last_seen_run"),
    )
    counts = j.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged", "absent", "conflict")])
    return {"records": records, "status": j.select(key, "status"), "conflicts": j.filter("_clash").select(key, "old", "new"), "counts": counts}


def incremental_diff(catalog: DataFrame, baseline: DataFrame, key: str, fields: list[str], identity: list[str], selection: DataFrame | None = None) -> DataFrame:
    """NEW, EXISTING_IDENTICAL, UPDATE_NEEDED or CONFLICT by content hash; absence deletes nothing.

    ``baseline(key, content_hash, *identity)``.  A selected key missing from the catalog is a
    conflict.
    """
    c = catalog.select(key, metadata_hash(*fields).alias("_hash"), F.struct(*identity).alias("_id"), F.lit(True).alias("_here"))
    b = baseline.select(key, F.col("content_hash").alias("_old"), F.struct(*identity).alias("_old_id"), F.lit(True).alias("_known"))
    j = c.join(selection.select(key).distinct(), key, "right") if selection is not None else c
    j = j.join(b, key, "left")
    conflict: Column = F.lit(False)
    for f in identity:
        conflict = conflict | F.coalesce(F.col(f"_id.{f}") != F.col(f"_old_id.{f}"), F.lit(False))
    status = (
        F.when(F.col("_here").isNull(), "CONFLICT").when(F.col("_known").isNull(), "NEW").when(conflict, "CONFLICT")
        .when(F.col("_hash") == F.col("_old"), "EXISTING_IDENTICAL").otherwise("UPDATE_NEEDED")
    )
    return j.select(key, status.alias("status"))


def baseline_of(catalog: DataFrame, key: str, fields: list[str], identity: list[str]) -> DataFrame:
    return catalog.select(key, *identity, metadata_hash(*fields).alias("content_hash"))


def page_fingerprints(observations: DataFrame) -> DataFrame:
    """Per page: fingerprint of its surface and sorted ids, and how many posts it showed.

    ``observations(page, source_surface, post_uuid)``.  A page shows a bounded list of posts.
    """
    pages = observations.groupBy("page", "source_surface").agg(F.array_sort(F.collect_set("post_uuid")).alias("_ids"), F.count("post_uuid").alias("detected_posts"))
    text = F.concat_ws("\n", "source_surface", F.array_join("_ids", ","))
    return pages.select("page", "source_surface", "detected_posts", F.sha2(text, 256).alias("fingerprint"))


def bundle_pages(observations: DataFrame, key: str, fields: list[str]) -> dict[str, DataFrame]:
    """Distinct records of a run over all pages: a later observation that differs replaces.

    ``observations`` carries ``page`` and ``place`` (order within the page).
    """
    order = F.struct("page", "place")
    last = observations.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r"), F.min(order).alias("_first"), F.count("*").alias("_n"))
    records = last.select(key, *[F.col(f"_r.{f}").alias(f) for f in fields], F.col("_first.page").alias("first_page"))
    counts = last.agg(F.count("*").alias("records"), F.sum(F.col("_n") - 1).alias("duplicates_skipped"))
    return {"records": records, "counts": counts}


def bundle_to_staging(creators: DataFrame, posts: DataFrame) -> dict[str, DataFrame]:
    """Flat creator and post targets; plans wait for a stable id."""
    cid = F.when(F.col("username").isNotNull(), F.concat(F.lit("username:"), F.lower("username"))).otherwise(F.concat(F.lit("profile:"), "profile_url"))
    plans = creators.select(
        F.when(F.col("username").isNotNull(), F.concat(F.lit("username:"), F.lower("username"))).alias("creator_external_id"), F.explode("plans").alias("plan_name"),
        F.lit("NEEDS_STABLE_PLAN_ID").alias("import_status"),
    )
    fixed = {"source_type": F.lit("OFFICIAL_AUTH_UI"), "permission_scope": F.lit("AFFILIATE_VISIBLE")}
    c = creators.select(cid.alias("external_id"), "username", F.col("creator_name").alias("name"), "profile_url").withColumns(fixed)
    p = posts.select(
        F.col("post_uuid").alias("external_id"), F.col("post_public_url").alias("public_url"), "title",
        F.when(F.col("creator_username").isNotNull(), F.concat(F.lit("username:"), F.lower("creator_username"))).alias("creator_external_id"),
        "price", "media_type", F.lit(True).alias("affiliate_enabled"),
    ).withColumns(fixed)
    return {"creators": c, "posts": p, "unresolved_plans": plans}


def dedupe_records(df: DataFrame, order: str) -> DataFrame:
    """Mark records whose id or URL was taken by an earlier kept record.

    ``df(entity_type, external_id, official_url)``; the reason names the id when both clash.
    """
    keyed = df.withColumn("_id", F.when(F.col("external_id").isNotNull(), F.concat_ws(":", "entity_type", "external_id")))
    kept = first_come(keyed.select(order, "_id", "official_url"), ["_id", "official_url"], order)
    ids = kept.filter("_id is not null").select("_id", F.col(order).alias("_id_at"))
    j = keyed.join(ids, "_id", "left").join(kept.select(order, F.lit(True).alias("_kept")), order, "left")
    same_id = F.coalesce(F.col("_id_at") < F.col(order), F.lit(False))
    reason = F.when(F.col("_kept").isNull(), F.when(same_id, "DUPLICATE_STABLE_ID").otherwise("DUPLICATE_OFFICIAL_URL"))
    return j.withColumn("duplicate_reason", reason).select(*df.columns, "duplicate_reason")


def staging_plan(records: DataFrame, existing: DataFrame, data_source_id=None) -> DataFrame:
    """NEW, UNCHANGED, EXISTING_CHANGED or CONFLICT with a reason per frozen record.

    ``records(entity_type, external_id, official_url, creator_external_id, metadata_hash,
    classification)``; ``existing`` adds ``data_source_id, visibility, review_status``.
    """
    fields = ("official_url", "creator_external_id", "metadata_hash", "data_source_id", "visibility", "review_status")
    by_id = existing.groupBy("external_id").agg(F.count("*").alias("_in"), F.min(F.struct(*fields)).alias("row"))
    by_url = existing.groupBy("official_url").agg(F.count("*").alias("_un"), F.min("external_id").alias("_url_id"))
    j = records.join(by_id, "external_id", "left").join(by_url, "official_url", "left")
    exact = (
        F.col("row.official_url").eqNullSafe(F.col("official_url")) & F.col("row.metadata_hash").eqNullSafe(F.col("metadata_hash"))
        & (F.col("row.visibility") == "public") & (F.col("row.review_status") == "public_metadata_staged")
        & ((F.col("entity_type") != "post") | F.col("row.creator_external_id").eqNullSafe(F.col("creator_external_id")))
    )
    foreign = F.lit(data_source_id is not None) & ~F.col("row.data_source_id").eqNullSafe(F.lit(data_source_id))
    rules = (
        (~F.col("classification").eqNullSafe(F.lit("PUBLIC_SAFE_METADATA")), "CONFLICT", "NOT_PUBLIC_SAFE_METADATA"),
        ((F.col("_in") > 1) | (F.col("_un") > 1), "CONFLICT", "MULTIPLE_EXISTING_IDENTITY_ROWS"),
        (F.col("_url_id") != F.col("external_id"), "CONFLICT", "OFFICIAL_URL_ID_CONFLICT"),
        (F.col("_in").isNull(), "NEW", "TARGET_ABSENT"), (foreign, "CONFLICT", "DATA_SOURCE_CONFLICT"), (exact, "UNCHANGED", "EXACT_FROZEN_MATCH"),
    )
    (condition, s, r), *others = rules
    state, reason = F.when(condition, s), F.when(condition, r)
    for condition, s, r in others:
        state, reason = state.when(condition, s), reason.when(condition, r)
    return j.select("external_id", state.otherwise("EXISTING_CHANGED").alias("state"), reason.otherwise("EXISTING_ROW_DIFFERS").alias("reason"))


def target_selection(catalog: DataFrame, page: DataFrame, excluded: DataFrame, limit: int, source: PostSource) -> DataFrame:
    """Eligible posts without a link that the current page shows, in page order.

    ``page(place, post_uuid, post_public_url)``; a malformed or repeated identity fails.
    """
    good = source.is_post_url("post_public_url", "post_uuid")
    eligible = catalog.filter(good & F.col("eligible") & F.col("displayed_affiliate_url").isNull() & (F.upper(F.coalesce("affiliate_link_status", F.lit(""))) != "ACTIVE"))
    once = lambda df, message: df.groupBy(F.lower("post_uuid").alias("post_uuid")).agg(F.count("*").alias("_n"), *([F.min("place").alias("place"), F.min(good).alias("_good")] if "place" in df.columns else [])).withColumn(
        "post_uuid", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("post_uuid")))
    e = once(eligible, "eligible target identity repeats").select("post_uuid")
    p = once(page, "page identity repeats").withColumn("post_uuid", F.when(~F.col("_good"), F.raise_error("page identity invalid")).otherwise(F.col("post_uuid")))
    out = p.join(e, "post_uuid", "left_semi").join(excluded.select(F.lower("post_uuid").alias("post_uuid")), "post_uuid", "left_anti")
    return top_rows(out.select("place", "post_uuid", source.post_url(F.col("post_uuid")).alias("canonical_url")), [("place", "asc")], limit)


def post_text_fields(posts: DataFrame, text: str = "text") -> DataFrame:
    """Fields read off a post's visible text: yen amounts, rates, durations, names, media type.

    A relative time phrase is kept as a phrase and never turned into a date.
    """
    t = F.regexp_replace(F.trim(F.col(text)), "\\s+", " ")
    number = "([0-9][0-9,，]*)"
    digits = lambda c: F.regexp_replace(c, "[,，]", "").try_cast("bigint")
    first = lambda pattern, group=1: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    rate_label = "(?:アフィ(?:リエイト)?報酬率|報酬率|報酬単価)"
    in_brackets = first(rate_label + "[^0-9%]{0,20}[0-9]+(?:[.][0-9]+)?\\s*%\\s*[（(]\\s*[¥￥]\\s*" + number + "\\s*円?\\s*[）)]")
    explicit = [F.coalesce(first(f"{label}[^0-9¥￥%]{{0,12}}(?:[（(]\\s*)?[¥￥]\\s*{number}"), first(f"{label}[^0-9¥￥%]{{0,12}}(?:[（(]\\s*)?{number}\\s*円")) for label in ("推定報酬", "見込報酬", "報酬額")]
    duration = first("(?:^|\\s)([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)(?=\\s|$)")
    parts = F.transform(F.split(duration, ":"), lambda x: x.try_cast("int"))
    n = F.size(parts)
    minutes, seconds = F.element_at(parts, -2), F.element_at(parts, -1)
    ok = (seconds <= 59) & ((n == 2) | (minutes <= 59))
    total = F.when(ok, F.aggregate(parts, F.lit(0), lambda acc, x: acc * 60 + x))
    labelled = lambda labels: F.coalesce(*[F.coalesce(first(f"{x}[^0-9]{{0,16}}{number}"), first(f"{number}[^0-9]{{0,8}}{x}")) for x in labels])
    video = F.when(total.isNotNull(), True).otherwise(t.rlike("(?i)(?:^|\\s)(?:動画|video)(?:\\s|$)"))
    return posts.withColumns(
        {
            "username": first("(?:^|\\s)@([A-Za-z0-9_.-]{1,64})(?=\\s|$)"),
            "price": digits(first("価格[^0-9¥￥]{0,20}[¥￥]?\\s*" + number + "\\s*円?")),
            "likes": digits(labelled(("いいね", "お気に入り"))),
            "reward_rate": first(rate_label + "[^0-9]{0,20}([0-9]+(?:[.][0-9]+)?)\\s*%").try_cast("double"),
            "estimated_reward": digits(F.coalesce(in_brackets, *explicit)),
            "video_duration": F.when(total.isNotNull(), duration), "duration_seconds": total,
            "relative_published_text": first("(?:たった今|昨日|[0-9]+\\s*(?:秒|分|時間|日|週間|週|か月|ヶ月|月|年)前)", 0),
            "media_type": F.when(video, "video").when(t.rlike("(?i)(?:^|\\s)(?:画像|image)(?:\\s|$)"), "image").otherwise("unknown"),
        }
    )


