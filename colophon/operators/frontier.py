"""Frozen manifests and the anchored window that continues them in a shifted listing."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from colophon import constants as K
from colophon.operators.ranking import Order, numbered, top_rows
from colophon.session import reuse


def _ordered_hash(lines: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), ""), 256)


def membership_hashes(df: DataFrame, window: str, position: str, id_col: str, payload: str, limit: int = K.MANIFEST_ROWS_MAX) -> DataFrame:
    """Ordered SHA-256 of ``id\\n`` and of ``id\\thash\\n`` lines, one pair per manifest window.

    The hash of an ordered list is serial by nature, so a manifest is limited to ``limit``
    rows.  Positions are cut into windows of that size, and a window that holds more rows
    fails instead of growing.
    """
    size = F.count("*")
    checked = df.groupBy(window).agg(
        size.alias("rows"),
        _ordered_hash(F.struct(F.col(position).alias("at"), F.concat(F.col(id_col), F.lit("\n")).alias("line"))).alias("membership_sha256"),
        _ordered_hash(F.struct(F.col(position).alias("at"), F.concat(F.col(id_col), F.lit("\t"), F.col(payload), F.lit("\n")).alias("line"))).alias("payload_sha256"),
    )
    return checked.withColumn("rows", F.when(F.col("rows") > limit, F.raise_error("manifest window too large")).otherwise(F.col("rows")))


def manifest_digest(df: DataFrame, order: Order, id_col: str, payload: str, fan: int = K.MANIFEST_ROWS_MAX, steps: int | None = None) -> DataFrame:
    """One row for a manifest of any size: ``rows, membership_sha256, payload_sha256``.

    The ordered rows are hashed in windows of ``fan``, then the ordered hashes of ``fan`` windows
    each, and so on until one is left; two steps are made at least.  No task holds more than
    ``fan`` lines of a window.  No rows give no digest.

    With ``steps`` so many are made, and the last one hashes all that is left at once: after two
    steps that is a line of 65 bytes for each ``fan`` rows in one task.
    """
    placed = numbered(df.select(id_col, F.col(payload).alias("_payload"), *[c for c, _ in order if c not in (id_col, payload)]), [], order, "_place")
    level = placed.withColumn("_window", F.floor((F.col("_place") - 1) / fan).cast("bigint"))
    level = reuse(membership_hashes(level, "_window", "_place", id_col, "_payload", fan), "manifest")
    for step in count(2):
        last = step == steps
        up = level.withColumn("_up", F.lit(0).cast("bigint") if last else F.floor(F.col("_window") / fan).cast("bigint"))
        hashes = [_ordered_hash(F.struct(F.col("_window").alias("at"), F.concat(c, F.lit("\n")).alias("line"))).alias(c) for c in ("membership_sha256", "payload_sha256")]
        level = reuse(up.groupBy(F.col("_up").alias("_window")).agg(F.sum("rows").alias("rows"), *hashes), "manifest")
        if last or level.count() <= 1:
            return level.drop("_window")


def frontier_anchors(frontier: DataFrame, n: int = 25) -> DataFrame:
    """Last ``n`` rows of a frontier with their offsets and places (first row is place 1).

    ``frontier(source_offset, external_id, code_key, release_date, payload_hash)``.
    """
    total = frontier.agg(F.count("*").alias("n")).scalar()
    tail = top_rows(frontier, [("source_offset", "desc")], n)
    place = F.row_number().over(Window.orderBy(F.col("source_offset").desc()))  # n rows
    return tail.withColumn("previous_position", (total - place + 1).cast("bigint")).select(
        "external_id", "code_key", "release_date", "payload_hash", F.col("source_offset").alias("previous_offset"), "previous_position"
    )


def monotonic_check(anchors: DataFrame, position: str = "previous_position", offset: str = "live_offset") -> DataFrame:
    """Anchors that do not rise together with the one before them (anchors are a short list)."""
    w = Window.orderBy(position)
    prior = anchors.withColumns({"_p": F.lag(position).over(w), "_o": F.lag(offset).over(w)})
    return prior.filter((F.col("_p") >= F.col(position)) | (F.col("_o") >= F.col(offset))).drop("_p", "_o")


def anchored_window(
    listing: DataFrame, anchors: DataFrame, parent_ids: DataFrame, size: int, *, min_matches: int = 5,
    start: int = 1, page_size: int = 100, max_anchor_pages: int = 25, max_window_pages: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """``(records, report)``: the next ``size`` unseen ids after the deepest anchor.

    ``listing(offset, external_id, payload_hash)``.  The anchors must be found in order and
    at least ``min_matches`` of them by the page of the deepest one; the report's ``status``
    says ``ok``, ``anchor_not_found``, ``anchor_ambiguous`` or ``window_incomplete``.
    """
    seen = listing.filter((F.col("offset") >= start) & (F.col("offset") < start + (max_anchor_pages + max_window_pages) * page_size))
    live = seen.join(F.broadcast(anchors.select("external_id", "previous_offset", "previous_position", F.col("payload_hash").alias("_known"))), "external_id")
    deepest_place = anchors.agg(F.max("previous_position").alias("p")).scalar()
    page = F.floor((F.col("offset") - start) / page_size)
    found = live.withColumn("_page", page)
    ordered = Window.orderBy("previous_position")
    anchors_seen = found.groupBy("external_id", "previous_offset", "previous_position").agg(F.count("*").alias("_n"), F.min("offset").alias("live_offset"), F.max(F.col("payload_hash") == F.col("_known")).alias("_same"))
    checked = anchors_seen.withColumn("_bad", (F.col("_n") > 1) | F.coalesce(F.lag("live_offset").over(ordered) >= F.col("live_offset"), F.lit(False)))
    deep = F.when(F.col("previous_position") == deepest_place, F.col("live_offset"))
    early = F.when(F.col("live_offset") < start + max_anchor_pages * page_size, 1)
    report = checked.agg(
        F.max(deep).alias("live_offset"), F.max(F.when(F.col("previous_position") == deepest_place, F.col("previous_offset"))).alias("previous_offset"),
        F.count(early).alias("anchor_matches"), F.count_if("_same").alias("payload_matches"), F.coalesce(F.max("_bad"), F.lit(False)).alias("_bad"),
    )
    deepest = report.select("live_offset").scalar()
    last_page = F.floor((deepest - start) / page_size) + max_window_pages
    after = seen.filter((F.col("offset") > deepest) & (page < last_page))
    fresh = after.join(parent_ids.select("external_id").distinct(), "external_id", "left_anti").join(F.broadcast(anchors.select("external_id")), "external_id", "left_anti")
    first = fresh.groupBy("external_id").agg(F.min("offset").alias("live_offset"), F.min_by("payload_hash", "offset").alias("payload_hash"))
    records = top_rows(first, [("live_offset", "asc")], size)
    got = records.agg(F.count("*").alias("n")).scalar()
    status = (
        F.when(F.col("live_offset").isNull(), "anchor_not_found").when(F.col("_bad") | (F.col("anchor_matches") < min_matches), "anchor_ambiguous")
        .when(F.col("records") < size, "window_incomplete").otherwise("ok")
    )
    out = report.withColumn("records", got).withColumn("status", status).withColumn("drift", F.col("live_offset") - F.col("previous_offset")).drop("_bad")
    return records, out


def listing_slice(records: DataFrame, previous_ids: DataFrame, start: int, position: str = "position") -> DataFrame:
    """Frozen records of a listing slice with their offset and whether the last job had them."""
    prior = previous_ids.select("external_product_id").distinct().withColumn("_prior", F.lit(True))
    out = records.join(prior, "external_product_id", "left")
    return out.withColumns({"source_offset": F.col(position) - 1 + start, "in_previous": F.coalesce("_prior", F.lit(False))}).drop("_prior")
