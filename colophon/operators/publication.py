"""Publication gates, promotion into the catalog, and scope checks around writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.codes import blank_to_null, canonical_code
from colophon.functions.urls import allowed_pattern, matches
from colophon.operators.merging import changed_fields, dimension_key, merge_into
from colophon.operators.staging import safety_reasons


def _text(c: str) -> Column:
    return blank_to_null(c).isNotNull()


def publication_reasons(works: DataFrame, work_performers: DataFrame, source_links: DataFrame, sales_hosts: tuple[str, ...], image_hosts: tuple[str, ...]) -> DataFrame:
    """Reasons against publishing each work.

    ``works`` carries ``performer_id`` and the sourcing columns; ``work_performers(work_id)``
    and ``source_links(work_id)`` prove the relations; another work with the same external id
    or code key is a duplicate.
    """
    sales, image = allowed_pattern(sales_hosts), allowed_pattern(image_hosts)
    base = works.withColumn("_code", canonical_code("product_code")).withColumn("_key", F.lower(F.col("_code.key")))
    cast = work_performers.select(F.col("work_id").alias("id")).distinct().withColumn("_cast", F.lit(True))
    links = source_links.select(F.col("work_id").alias("id")).distinct().withColumn("_linked", F.lit(True))
    same_id = base.filter("external_product_id is not null").groupBy("external_product_id").agg(F.count("*").alias("_ids"))
    same_key = base.filter("_key is not null").groupBy("_key").agg(F.count("*").alias("_keys"))
    j = base.join(cast, "id", "left").join(links, "id", "left").join(same_id, "external_product_id", "left").join(same_key, "_key", "left")
    duplicate = (F.coalesce("_ids", F.lit(0)) > 1) | (F.coalesce("_keys", F.lit(0)) > 1)
    related = F.coalesce(F.col("_cast"), F.lit(False)) & F.col("performer_id").isNotNull()
    images = F.array_compact(F.array(blank_to_null("card_image_url"), blank_to_null("image_url")))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_code.canonical").isNull() | F.col("_code.key").isNull() | F.col("_code.rejected"), "normalized_product_code_missing"),
            F.when(~_text("title"), "title_missing"),
            F.when(~_text("source_name"), "source_provenance_missing"),
            F.when(~_text("external_product_id"), "external_product_id_missing"),
            F.when(~matches(F.trim("official_url"), sales), "official_url_not_allowed"),
            F.when(~_text("affiliate_url"), "affiliate_url_missing").when(~matches(F.trim("affiliate_url"), sales), "affiliate_url_not_allowed"),
            F.when(F.size(images) == 0, "image_missing").when(F.exists(images, lambda u: ~u.rlike(image)), "image_url_not_allowed"),
            F.when(~_text("performer"), "performer_metadata_missing"),
            F.when(~related, "performer_relation_missing"),
            F.when(F.col("_linked").isNull(), "source_relation_missing"),
            F.when(duplicate, "duplicate_detected"),
        )
    )
    return j.select(*works.columns, reasons.alias("reasons"))


PATCHED = (
    "title", "performer", "maker", "series", "label", "genre", "release_date", "sample_images", "card_image_url", "image_url",
    "video_url", "official_url", "affiliate_url", "external_product_id", "description",
)


def promote(staged: DataFrame, works: DataFrame, hosts: tuple[str, ...], source_name: str) -> dict[str, DataFrame]:
    """Move pending staged products into the catalog; one output table per target.

    ``staged``: normalised products with ``id, review_status, preview_status, linked_work_id,
    data_source_id, fetched_at``.  Only non-null fields patch a known work; a new work starts
    unpublished.  Products that fail a check go to ``errors`` and write nothing.

    Several products may be of one work.  They count in order of ``id``: each field of the work is
    the last value that is there, its performers and genres the last list that is not empty, and the
    change log holds the change by all of them.  Each product has its own link and status, and each
    external id of a source one offer, that of its last product.
    """
    pending = staged.filter("review_status = 'pending'").withColumn("_reasons", safety_reasons(hosts))
    blocked = F.col("preview_status").isin("duplicate", "needs_review")
    message = F.when(blocked, F.lit("review required")).when(F.size("_reasons") > 0, F.array_join("_reasons", ","))
    judged = pending.withColumn("message", message)
    errors = judged.filter("message is not null").select("id", "message")
    ready = judged.filter("message is null").drop("message", "_reasons")
    work_type = dict(works.dtypes)["id"]
    new_id = dimension_key(F.lit("work"), F.col("product_code")) if work_type == "string" else F.abs(F.xxhash64("product_code"))
    by_link = ready.join(works.select(F.col("id").alias("_linked")), F.col("linked_work_id") == F.col("_linked"), "left")
    codes = works.select(F.col("id").alias("_coded"), F.col("product_code").alias("_code"))
    placed = by_link.join(codes, F.col("product_code") == F.col("_code"), "left").withColumn("work_id", F.coalesce("_linked", "_coded", new_id))

    have = set(works.columns)
    given = {c: F.col(c) for c in PATCHED if c in have} | {
        "performer": F.try_element_at("performers", F.lit(1)), "genre": F.try_element_at("genres", F.lit(1)),
        "sample_images": F.when(F.size("sample_images") > 0, F.col("sample_images")),
    }
    given = {c: v for c, v in given.items() if c in have}
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("id")))
    listed = lambda c: F.when(F.size(c) > 0, F.col(c))
    patches = placed.groupBy("work_id").agg(
        F.max_by("product_code", "id").alias("product_code"), F.max_by("fetched_at", "id").alias("_checked"),
        last(listed("performers")).alias("_performers"), last(listed("genres")).alias("_genres"), *[last(v).alias(f"_new_{c}") for c, v in given.items()],
    )
    stored = works.select(F.col("id").alias("work_id"), F.struct(*[c for c in works.columns if c != "id"]).alias("before"))
    j = patches.join(stored, "work_id", "left")
    fields = {c: F.coalesce(f"_new_{c}", f"before.{c}") for c in given}
    fields["source_name"], fields["source_checked_at"] = F.lit(source_name), F.col("_checked")
    zero = F.lit(0).cast("bigint")
    for c, default in (("popularity", zero), ("favorite_count", zero), ("is_published", F.lit(False))):
        fields[c] = F.coalesce(F.col(f"before.{c}"), default) if c in have else default
    fields = {c: v for c, v in fields.items() if c in have}
    rest = [c for c in works.columns if c not in fields and c not in ("id", "product_code")]
    written = j.select(
        F.col("work_id").alias("id"), "product_code", "before", *[v.alias(c) for c, v in fields.items()], *[F.col(f"before.{c}").alias(c) for c in rest], "_performers", "_genres",
    )
    logged = list(fields)
    log = written.filter("before is not null").withColumn("after", F.struct(*logged)).withColumn("changed_fields", changed_fields(logged))
    offer = F.struct(
        "work_id", F.col("id").alias("staged_id"), "official_url", "affiliate_url", (F.col("price") if "price" in placed.columns else F.lit(None)).alias("price"),
        F.lit("JPY").alias("currency"), F.lit("available").alias("availability"), F.col("fetched_at").alias("last_checked_at"),
    )
    offers = placed.groupBy("data_source_id", "external_product_id").agg(F.max_by(offer, "id").alias("_offer")).select("data_source_id", "external_product_id", "_offer.*")
    done = placed.select("id", F.lit("promoted").alias("review_status"), F.col("work_id").alias("promoted_work_id"), F.lit(None).cast("string").alias("error_message"))
    failed = errors.select("id", F.lit("error").alias("review_status"), F.lit(None).cast(work_type).alias("promoted_work_id"), F.col("message").alias("error_message"))
    return {
        "works": merge_into(works, written.select(*works.columns), ["id"]),
        "performers": written.select(F.col("id").alias("work_id"), F.posexplode(F.array_distinct("_performers")).alias("position", "name")),
        "genres": written.select(F.col("id").alias("work_id"), F.explode(F.array_distinct("_genres")).alias("name")),
        "offers": offers,
        "source_links": placed.select("work_id", F.col("id").alias("staged_id"), F.lit(1.0).alias("confidence")),
        "change_log": log.filter(F.size("changed_fields") > 0).select(F.col("id").alias("work_id"), "changed_fields", F.to_json("before").alias("before_data"), F.to_json("after").alias("after_data"), F.lit("feed").alias("change_source")),
        "staged_updates": done.unionByName(failed),
        "errors": errors,
    }


def replace_links(existing: DataFrame, links: DataFrame, key: str = "work_id") -> DataFrame:
    """Links of the written works replace their old ones; other works keep theirs."""
    return existing.join(links.select(key).distinct(), key, "left_anti").unionByName(links, allowMissingColumns=True)


def verify_promotion_input(sources: DataFrame, inspected: DataFrame, expected_count: int, membership: str, uuid_pattern: str) -> tuple[DataFrame, DataFrame]:
    """``(issues, states)`` of a promotion list against the staged rows it names."""
    norm = lambda c: F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z0-9]", "")
    s = sources.select(F.trim("source_id").alias("source_id"), F.upper(F.trim("product_code")).alias("product_code"), F.trim("external_product_id").alias("external_product_id"), F.trim("membership").alias("membership"))
    counts = s.groupBy("source_id").agg(F.count("*").alias("_copies"))
    rows = inspected.select(F.col("id").alias("source_id"), F.col("external_product_id").alias("_ext"), norm("code_key").alias("_code"), "review_status", "preview_status", "promoted_work_id", F.lit(True).alias("_seen"))
    j = s.join(counts, "source_id", "left").join(rows, "source_id", "left")
    issue = (
        F.when(~F.coalesce(F.col("source_id").rlike(uuid_pattern), F.lit(False)), "SOURCE_ID_INVALID")
        .when(norm("product_code") == "", "PRODUCT_CODE_INVALID")
        .when(F.coalesce(F.col("external_product_id"), F.lit("")) == "", "EXTERNAL_PRODUCT_ID_INVALID")
        .when(~F.col("membership").eqNullSafe(F.lit(membership)), "FOREIGN_MEMBERSHIP")
        .when(F.col("_copies") > 1, "DUPLICATE_SOURCE_ID")
        .when(F.col("_seen").isNull(), "UNKNOWN_SOURCE")
        .when(~F.col("_ext").eqNullSafe(F.col("external_product_id")) | (F.col("_code") != norm("product_code")), "SOURCE_MISMATCH")
    )
    state = (
        F.when((F.col("review_status") == "promoted") & F.col("promoted_work_id").isNotNull(), "completed")
        .when((F.col("review_status") == "pending") & (F.col("preview_status") == "new"), "pending")
        .when(F.col("review_status") == "error", "failed").otherwise("foreign")
    )
    judged = j.withColumn("issue", issue).withColumn("state", F.when(F.col("issue").isNull(), state))
    total = judged.agg(F.count("*").alias("n")).filter(F.col("n") != expected_count)
    count_issue = total.select(F.lit(None).cast("string").alias("source_id"), F.concat(F.lit("SOURCE_INPUT_COUNT_MISMATCH:"), F.col("n").cast("string")).alias("issue"))
    issues = judged.filter("issue is not null").select("source_id", "issue").unionByName(count_issue)
    return issues, judged.filter("issue is null").select("source_id", "state", "review_status", "preview_status", "promoted_work_id")


def verify_write_scope(before: DataFrame, after: DataFrame, planned: DataFrame, key: str, fields: list[str], expected: dict[str, str | None]) -> DataFrame:
    """Violations of a write that may only add the planned rows.

    Rows outside the plan must be identical; each planned row must be absent before, present
    once after, equal in the planned fields, and carry the ``expected`` values.
    """
    every = [c for c in before.columns if c != key]
    b = before.groupBy(key).agg(F.count("*").alias("_bn"), F.min(F.struct(*every)).alias("_b"))
    a = after.groupBy(key).agg(F.count("*").alias("_an"), F.min(F.struct(*every)).alias("_a"))
    p = planned.select(key, F.struct(*fields).alias("_p")).withColumn("_planned", F.lit(True))
    j = b.join(a, key, "full_outer").join(p, key, "full_outer").fillna(0, ["_bn", "_an"])
    wrong = [~F.col(f"_a.{f}").eqNullSafe(F.col(f"_p.{f}")) for f in fields]
    wrong += [~F.col(f"_a.{f}").eqNullSafe(F.lit(v)) for f, v in expected.items()]
    issue = (
        F.when(F.col("_planned").isNull(), F.when((F.col("_bn") != F.col("_an")) | ~F.col("_b").eqNullSafe(F.col("_a")), "UNEXPECTED_MUTATION"))
        .when((F.col("_bn") != 0) | (F.col("_an") != 1), "TARGET_DELTA_MISMATCH")
        .when(reduce(lambda x, y: x | y, wrong), "SAVED_ROW_MISMATCH")
    )
    return j.withColumn("issue", issue).filter("issue is not null").select(key, "issue")


def exact_scope_rows(handoff: DataFrame, works: DataFrame, staged: DataFrame, source_name: str) -> DataFrame:
    """Handoff rows with the first thing wrong with them, or null.

    ``handoff(work_id, product_code, external_product_id)``; of several staged rows the one
    promoted to the work is preferred, then one with the work's code.
    """
    key = lambda c: canonical_code(c)["canonical"]
    w = works.groupBy(F.col("id").alias("work_id")).agg(F.count("*").alias("_works"), F.min(F.struct("product_code", "is_published", "source_name")).alias("_w"))
    promoted = staged.filter("promoted_work_id is not null").select(F.col("promoted_work_id").alias("work_id"), F.struct("external_product_id", "code_key").alias("_s"))
    s1 = promoted.groupBy("work_id").agg(F.count("*").alias("_linked"), F.min("_s").alias("_s1"))
    s2 = staged.filter("promoted_work_id is null").groupBy(F.col("code_key").alias("_k")).agg(F.count("*").alias("_coded"), F.min(F.struct("external_product_id", "code_key")).alias("_s2"))
    j = handoff.join(w, "work_id", "left").join(s1, "work_id", "left").withColumn("_k", F.regexp_replace(F.upper("product_code"), "[^A-Z0-9]", "")).join(s2, "_k", "left")
    source = F.coalesce("_s1", "_s2")
    count = F.coalesce("_linked", "_coded", F.lit(0))
    same_code = (key(source["code_key"]).eqNullSafe(F.col("_k"))) | key(source["external_product_id"]).eqNullSafe(F.upper("product_code")) | F.regexp_replace(F.upper(source["external_product_id"]), "[^A-Z0-9]", "").eqNullSafe(F.col("_k"))
    issue = (
        F.when(F.coalesce("_works", F.lit(0)) == 0, "WORK_MISSING").when(F.col("_works") > 1, "WORK_DUPLICATE")
        .when(count == 0, "SOURCE_MISSING").when(count > 1, "SOURCE_DUPLICATE")
        .when(~key(F.col("_w.product_code")).eqNullSafe(F.upper("product_code")), "WORK_CODE_MISMATCH")
        .when(~F.coalesce(F.col("_w.is_published"), F.lit(False)) | ~F.coalesce(F.upper(F.col("_w.source_name")).contains(source_name.upper()), F.lit(False)), "WORK_NOT_PUBLISHED")
        .when(~same_code, "SOURCE_CODE_MISMATCH")
        .when(_text("external_product_id") & ~F.trim("external_product_id").eqNullSafe(F.trim(source["external_product_id"])), "SOURCE_ID_MISMATCH")
    )
    return j.select(*handoff.columns, issue.alias("issue"))
