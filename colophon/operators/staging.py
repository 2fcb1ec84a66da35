"""Staging of feed items against works and earlier staged rows.

Every lookup is first cut down to the batch's keys and aggregated to one row per key, so an
item meets at most one row per lookup and a crowded key cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.functions.codes import code_key_lower, code_key_upper
from colophon.functions.urls import allowed_pattern, matches
from colophon.operators.ranking import latest_per_key, numbered
from colophon.session import reuse

COMPARED = ("title", "performers", "maker", "series", "genres")


def match_works_for_import(items: DataFrame, works: DataFrame) -> DataFrame:
    """Works whose external id **or** code key belongs to an item.

    ``items(external_product_id, code_key)``, ``works(id, external_product_id, product_code)``.
    Two semi joins; one OR condition would compare every pair.
    """
    keys = reuse(items.select("external_product_id", "code_key").distinct())
    ids = keys.filter("external_product_id <> ''").select("external_product_id").distinct()
    codes = keys.filter("code_key is not null").select(F.lower("code_key").alias("_key")).distinct()
    by_id = works.join(ids, "external_product_id", "left_semi").select("id")
    by_code = works.withColumn("_key", code_key_lower("product_code")).join(codes, "_key", "left_semi").select("id")
    return works.join(by_id.unionByName(by_code).distinct(), "id", "left_semi")


def mark_existing(df: DataFrame, known: DataFrame, reason: str = "EXACT_DB_MATCH") -> DataFrame:
    """Flag rows whose id or code is among the known ones; ``known(external_product_id, code_key)``."""
    ids = known.filter("external_product_id is not null").select("external_product_id").distinct().withColumn("_i", F.lit(True))
    codes = known.filter("code_key is not null").select("code_key").distinct().withColumn("_c", F.lit(True))
    out = df.join(ids, "external_product_id", "left").join(codes, "code_key", "left")
    out = out.withColumn("already_exists", F.coalesce("_i", "_c", F.lit(False))).drop("_i", "_c")
    if "reason" in df.columns:
        out = out.withColumn("reason", F.when(F.col("already_exists"), F.concat("reason", F.array(F.lit(reason)))).otherwise(F.col("reason")))
    return out


def exclude_existing(df: DataFrame, known: DataFrame) -> DataFrame:
    return mark_existing(df, known).filter("not already_exists").select(*df.columns)


def batch_duplicates(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that repeat, with whether their payloads differ; codes shared by more than one id."""
    repeated = items.filter("external_product_id <> ''").groupBy("external_product_id").agg(
        F.count("*").alias("copies"), (F.min("payload_hash") != F.max("payload_hash")).alias("conflict")
    ).filter("copies > 1")
    shared = items.filter("external_product_id <> '' and code_key is not null").groupBy("code_key").agg(
        F.min("external_product_id").alias("_a"), F.max("external_product_id").alias("_b")
    ).filter("_a <> _b").select("code_key")
    return repeated, shared


def find_candidate_duplicates(items: DataFrame, works: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Per item the other candidate (promoted first, then lowest id) and the work with its key.

    Each key needs only its two best candidates: the best one that is not the item itself is
    among them.
    """
    key = lambda c: code_key_upper(c, strict_reference)
    keyed = items.select("id", "status", key("product_code").alias("_key")).filter("_key is not null")
    pool = keyed.filter("status in ('pending','promoted')").withColumn("_late", F.when(F.col("status") == "promoted", 0).otherwise(1))
    pool = pool.withColumn("_place", F.struct("_late", "id"))
    best = pool.groupBy("_key").agg(F.min("_place").alias("_first"))
    second = pool.join(best, "_key").filter(F.col("_place") != F.col("_first")).groupBy("_key").agg(F.min("_place").alias("_second"))
    heads = best.join(second, "_key", "left")
    work = works.select(key("product_code").alias("_key"), "id").filter("_key is not null").groupBy("_key").agg(F.min("id").alias("duplicate_work_id"))
    out = keyed.join(heads, "_key", "left").join(work, "_key", "left")
    other = F.when(F.col("_first.id") == F.col("id"), F.col("_second.id")).otherwise(F.col("_first.id"))
    found = out.select("id", other.alias("duplicate_of"), "duplicate_work_id")
    return items.select("id").join(found, "id", "left")


def safety_reasons(hosts: tuple[str, ...]) -> Column:
    """Coded reasons that keep a normalised product out of the catalog until reviewed."""
    pattern = allowed_pattern(hosts)
    images = F.array_compact(F.concat(F.array("card_image_url", "image_url"), "sample_images"))
    return F.array_compact(
        F.array(
            F.col("code_rejection"),
            F.when(F.coalesce(F.col("external_product_id"), F.lit("")) == "", "external_product_id_missing"),
            F.when(F.col("product_code").isNull(), "product_code_missing"),
            F.when(F.col("code_key").isNull(), "normalized_product_code_missing"),
            F.when(F.col("title").isNull(), "title_missing"),
            F.when(F.size("performers") == 0, "performer_metadata_missing"),
            F.when(~matches("official_url", pattern), "official_url_not_allowed"),
            F.when(F.size(images) == 0, "image_missing").when(
                F.exists(images, lambda u: ~u.rlike(pattern)), "image_url_not_allowed"
            ),
            F.when(F.col("affiliate_url").isNull(), "affiliate_url_missing").when(
                ~matches("affiliate_url", pattern), "affiliate_url_not_allowed"
            ),
        )
    )


def _restrict(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return df.join(keys, key, "left_semi")


def _lookup(df: DataFrame, key: str, name: str, keys: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: how many rows match, and the lowest-id one."""
    row = F.struct("id", *COMPARED, *extra)
    return _restrict(df, key, keys).groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.min_by(row, "id").alias(name))


def stage_items(items: DataFrame, works: DataFrame, staged: DataFrame, hosts: tuple[str, ...], order: str = "position") -> DataFrame:
    """Decide for each item: new, update, unchanged or needs_review, with reasons.

    ``items``: output of ``normalize_items`` plus a unique ``order`` column.
    ``works(id, external_product_id, code_key, title, performers, maker, series, genres)``;
    ``staged``: the same plus ``review_status, preview_status, attempt_count, linked_work_id``.
    The first row of an id survives; rows without id are kept under their payload hash.
    """
    state = ("review_status", "preview_status", "attempt_count", "linked_work_id")
    keyed = reuse(items).withColumn("source_key", F.when(F.col("external_product_id") != "", F.col("external_product_id")).otherwise(F.concat(F.lit("missing:"), "payload_hash")))
    repeated, shared = batch_duplicates(keyed)
    first = latest_per_key(keyed, ["source_key"], [(order, "asc")])
    ids = first.filter("external_product_id <> ''").select("external_product_id").distinct()
    codes = first.filter("code_key is not null").select("code_key").distinct()

    s_ext = _lookup(staged, "external_product_id", "s_ext", ids, state)
    w_ext = _lookup(works, "external_product_id", "w_ext", ids)
    w_code = _lookup(works, "code_key", "w_code", codes)
    staged_codes = _restrict(staged, "code_key", codes)
    s_code = staged_codes.groupBy("code_key").agg(F.count("*").alias("s_code_n"))
    s_own = staged_codes.groupBy("code_key", "external_product_id").agg(F.count("*").alias("s_own_n"))

    j = first.join(repeated, "external_product_id", "left").join(shared.withColumn("_shared", F.lit(True)), "code_key", "left")
    j = j.join(s_ext, "external_product_id", "left").join(w_ext, "external_product_id", "left")
    j = j.join(w_code, "code_key", "left").join(s_code, "code_key", "left").join(s_own, ["code_key", "external_product_id"], "left")
    j = j.fillna(0, ["s_ext_n", "w_ext_n", "w_code_n", "s_code_n", "s_own_n"]).fillna(1, ["copies"]).fillna(False, ["conflict", "_shared"])

    mine = F.struct(*[F.col(c).alias(c) for c in COMPARED])

    def against(name: str) -> Column:
        theirs = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in COMPARED])
        return F.when(mine.eqNullSafe(theirs), "unchanged").otherwise("update")

    one_staged, one_work_id, one_code = F.col("s_ext_n") == 1, F.col("w_ext_n") == 1, F.col("w_code_n") == 1
    other_staged = F.col("s_code_n") > F.col("s_own_n")
    works_differ = (F.col("w_code_n") > 1) | (one_work_id & one_code & (F.col("w_ext.id") != F.col("w_code.id")))
    safety = safety_reasons(hosts)
    j = j.withColumn("_safety", safety)
    # (condition, review reason or None, decision)
    tree: list[tuple[Column, str | None, Column]] = [
        (F.size("_safety") > 0, None, F.lit("needs_review")),
        ((F.col("copies") > 1) & F.col("conflict"), "same_external_id_payload_conflict", F.lit("needs_review")),
        (F.col("copies") > 1, None, F.when(one_staged, against("s_ext")).otherwise("new")),
        (F.col("_shared"), "normalized_code_batch_collision", F.lit("needs_review")),
        ((F.col("s_ext_n") > 1) | (F.col("w_ext_n") > 1), "external_id_match_ambiguous", F.lit("needs_review")),
        (one_staged, None, against("s_ext")),
        (other_staged, "normalized_code_source_collision", F.lit("needs_review")),
        (works_differ, "work_match_ambiguous", F.lit("needs_review")),
        (one_work_id, None, against("w_ext")),
        (one_code, None, against("w_code")),
    ]
    decision, reason = None, None
    for condition, why, outcome in tree:
        label = F.lit(why).cast("string")
        decision = F.when(condition, outcome) if decision is None else decision.when(condition, outcome)
        reason = F.when(condition, label) if reason is None else reason.when(condition, label)
    linked = F.coalesce(
        F.when(one_staged, F.col("s_ext.linked_work_id")), F.when(one_work_id, F.col("w_ext.id")),
        F.when(one_code & ~other_staged, F.col("w_code.id")),
    )
    out = j.withColumn("preview_status", decision.otherwise("new")).withColumn("_why", reason)
    keep = [F.col("source_key").alias("external_product_id")] + [c for c in items.columns if c != "external_product_id"]
    return out.select(
        *keep, "preview_status",
        F.when(F.col("preview_status") != "needs_review", linked).alias("duplicate_work_id"),
        F.when(one_staged, F.col("s_ext.id")).alias("existing_staged_id"),
        F.when(one_staged, F.col("s_ext.review_status")).alias("existing_review_status"),
        F.when(one_staged, F.col("s_ext.preview_status")).alias("existing_preview_status"),
        F.coalesce(F.when(one_staged, F.col("s_ext.attempt_count")), F.lit(0)).cast("bigint").alias("existing_attempt_count"),
        F.array_union("_safety", F.array_compact(F.array("_why"))).alias("review_reasons"),
    )


def stage_counts(products: DataFrame) -> DataFrame:
    """One row: staged products per status."""
    return products.agg(F.count("*").alias("staged"), *[F.count_if(F.col("preview_status") == s).alias(s) for s in K.PREVIEW_STATES])


def merge_stage_state(products: DataFrame, source_id, fetched_at: str) -> DataFrame:
    """Rows to store: the review status survives, attempts grow, review and duplicate stick."""
    sticky = F.col("existing_preview_status").isin("needs_review", "duplicate")
    return products.select(
        F.lit(source_id).alias("data_source_id"), "external_product_id", "product_code", "original_product_code", "code_key", "payload_hash",
        F.lit(fetched_at).alias("fetched_at"),
        F.when(sticky, F.col("existing_preview_status")).otherwise(F.col("preview_status")).alias("preview_status"),
        F.coalesce("existing_review_status", F.lit("pending")).alias("review_status"),
        "duplicate_work_id",
        F.nullif(F.array_join("review_reasons", ","), F.lit("")).alias("error_message"),
        (F.greatest(F.lit(0), "existing_attempt_count") + 1).cast("bigint").alias("attempt_count"),
    )


def batch_report(items: DataFrame, products: DataFrame, works: DataFrame, staged: DataFrame) -> DataFrame:
    """Counters of a staging run in one row."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    base = items.agg(
        F.count("*").alias("received"),
        F.count_if((F.col("external_product_id") != "") & F.col("product_code").isNotNull() & F.col("title").isNotNull()).alias("normalized"),
        missing("product_code").alias("missing_product_code"),
        F.count_if(F.size("performers") == 0).alias("missing_performer"),
        missing("maker").alias("missing_maker"), missing("series").alias("missing_series"),
        F.count("series").alias("series_present"), F.count("image_url").alias("image_urls"),
        F.count_if(F.size("sample_images") > 0).alias("with_sample_images"), F.sum(F.size("sample_images")).alias("sample_image_urls"),
        F.count("affiliate_url").alias("affiliate_urls"), F.count("official_url").alias("official_urls"),
    )
    repeated, shared = batch_duplicates(items)
    matched = lambda t: exclude_existing(items, t).agg(F.count("*").alias("n"))
    row = base.crossJoin(F.broadcast(stage_counts(products)))  # one-row results
    total = F.col("received")
    row = row.withColumn("repeated_ids", repeated.agg(F.count("*").alias("n")).scalar())
    row = row.withColumn("codes_with_many_ids", shared.agg(F.count("*").alias("n")).scalar())
    row = row.withColumn("in_works", total - matched(works.select("external_product_id", "code_key")).scalar())
    return row.withColumn("in_staged", total - matched(staged.select("external_product_id", "code_key")).scalar())


def url_hosts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct hosts per URL column, with row counts."""
    host = lambda c: F.lower(F.regexp_extract(c, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), host(c).alias("host")) for c in columns])))
    return rows.filter("host <> ''").groupBy("field", "host").agg(F.count("*").alias("urls"))


def reason_counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, column: str, classes: tuple[str, ...]) -> DataFrame:
    """Rows per class, with zero for classes that do not occur."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    return every.join(counts, "class", "left").fillna(0, ["n"])


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null-or-blank values per column, one row per column, from a single scan."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    wide = df.agg(*[F.count_if(blank(c)).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])))


def select_safe_pending(staged: DataFrame, hosts: tuple[str, ...], descending: bool = False, batch: int = 5) -> DataFrame:
    """New pending products in fetch order with a batch number; any unsafe one fails the job."""
    rows = staged.filter("preview_status = 'new' and review_status = 'pending'")
    unsafe = F.size(safety_reasons(hosts)) > 0
    checked = rows.withColumn("external_product_id", F.when(unsafe, F.raise_error("unsafe new candidate")).otherwise(F.col("external_product_id")))
    ranked = numbered(reuse(checked), [], [("fetched_at", "desc" if descending else "asc"), ("id", "asc")], "place")
    return ranked.withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("bigint")).drop("place")


def freeze_records(candidates: DataFrame, products: DataFrame, order: str = "position") -> DataFrame:
    """Classify prioritised candidates by their staged result.

    ``candidates``: normalised items with ``expected_id`` and ``expected_code`` of the lane
    choice; a later copy of an id is a duplicate whatever its own content.
    """
    first = candidates.filter("external_product_id <> ''").groupBy("external_product_id").agg(F.min(order).alias("_first"))
    p = products.select("external_product_id", "preview_status", "review_reasons")
    j = candidates.join(first, "external_product_id", "left").join(p, "external_product_id", "left")
    repeated = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    mismatch = ~F.col("expected_id").eqNullSafe(F.col("external_product_id")) | ~F.col("expected_code").eqNullSafe(F.col("code_key"))
    absent = F.col("preview_status").isNull()
    clash = F.exists("review_reasons", lambda r: r.rlike("duplicate|collision|ambiguous"))
    label = (
        F.when(mismatch, "INVALID").when(repeated, "DUPLICATE").when(absent, "INVALID")
        .when((F.col("preview_status") == "new") & (F.size("review_reasons") == 0), "SAFE_NEW")
        .when(F.col("preview_status") == "unchanged", "EXISTING_UNCHANGED")
        .when(F.col("preview_status") == "update", "EXISTING_UPDATE")
        .when((F.col("preview_status") == "duplicate") | clash, "DUPLICATE")
        .when(F.col("preview_status") == "needs_review", "NEEDS_REVIEW").otherwise("INVALID")
    )
    reasons = (
        F.when(mismatch, F.array(F.lit("priority_normalized_identity_mismatch")))
        .when(repeated, F.array(F.lit("same_window_external_id_duplicate")))
        .when(absent, F.array(F.lit("staged_product_missing")))
        .when(F.col("preview_status").isin("needs_review", "duplicate"), F.col("review_reasons"))
        .otherwise(F.array().cast("array<string>"))
    )
    return j.select(
        *candidates.columns, label.alias("classification"), reasons.alias("reason_codes"), (F.size("performers") > 0).alias("performer_metadata_present"),
    )


def verify_frozen(records: DataFrame, hosts: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """Issues of records frozen as safe: recomputed hash, ids, performer, safety."""
    safety = safety_reasons(hosts)
    return records.withColumn(
        "issues",
        F.array_compact(
            F.array(
                F.when(~F.col("classification").eqNullSafe(F.lit("SAFE_NEW")), "classification"),
                F.when(F.col(raw).isNull(), "raw_payload"),
                F.when(F.col(raw).isNotNull() & ~F.col("payload_hash").eqNullSafe(F.sha2(raw, 256)), "payload_hash"),
                F.when(~F.col("frozen_id").eqNullSafe(F.col("external_product_id")), "external_id"),
                F.when(~F.col("frozen_code").eqNullSafe(F.col("code_key")), "normalized_code"),
                F.when(~F.col("performer_metadata_present") | (F.size("performers") < 1), "performer"),
                F.nullif(F.array_join(safety, ","), F.lit("")),
            )
        ),
    )
