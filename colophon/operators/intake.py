"""Candidates from posts, items and requests: extraction, media jobs, replies, event checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colophon import constants as K
from colophon.functions.codes import code_key_upper
from colophon.functions.dates import age_bucket, priority_score, release_age_days, review_signal
from colophon.functions.hashing import payload_hash
from colophon.functions.text import codes_in, hashtags, labelled
from colophon.operators.ranking import latest_per_key
from colophon.session import reuse
from colophon.sources.versioned import VersionedTable


def extract_code_candidates(posts: DataFrame, source: str, post_url: str) -> DataFrame:
    """One pending candidate per (post, code); ``posts(post_id, text, observed_at)``."""
    fields = {name: labelled("text", labels) for name, labels in K.POST_LABELS.items()}
    coded = posts.withColumns({**fields, "tags": hashtags("text")}).withColumn("product_code", F.explode(codes_in("text")))
    key = F.col("post_id").cast("string")
    return coded.select(
        F.lit(source).alias("source"), F.concat_ws(":", key, "product_code").alias("source_key"),
        F.concat(F.lit(post_url), key).alias("source_url"), "observed_at", "product_code", *fields, "tags",
        F.col("text").alias("payload_text"), F.lit("pending").alias("status"),
    )


def fallback_extraction(items: DataFrame) -> DataFrame:
    """Confidence of what a candidate already carries, without a model."""
    def present(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", 0.7).otherwise(0.0)

    has_code = F.coalesce(F.col("product_code"), F.lit("")) != ""
    field = {c: present(c) for c in ("title", "performer", "maker", "series")}
    code = F.when(F.coalesce(F.col("product_code").rlike("^[A-Z]+-[0-9]+$"), F.lit(False)), 0.85).otherwise(present("product_code"))
    return items.withColumn("confidence", F.when(has_code, 0.62).otherwise(0.2)).withColumn(
        "field_confidence", F.struct(code.alias("product_code"), *[v.alias(k) for k, v in field.items()])
    )


def media_jobs(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One job per (item, media url): http(s) and distinct.

    ``items(id, thumbnail_url, video_url, media_urls)``.
    """
    none = F.array().cast("array<string>")
    urls = F.concat(F.array("thumbnail_url", "video_url"), F.coalesce("media_urls", none))
    kept = F.array_distinct(F.filter(urls, lambda u: F.coalesce(u.rlike("^https?://"), F.lit(False))))
    jobs = items.select(F.col("id").alias("item_id"), F.explode(kept).alias("media_url")).distinct()
    kind = F.when(F.col("media_url").rlike("(?i)[.](mp4|webm|mov)([?]|$)"), "video").otherwise("image")
    jobs = jobs.withColumn("media_type", kind)
    return jobs.join(existing, ["item_id", "media_url"], "left_anti") if existing is not None else jobs


def priority_candidates(items: DataFrame, as_of: str, sort: str) -> DataFrame:
    """Flat candidates with age, score and the raw payload kept per sort.

    ``items(raw, item, position)`` as read by ``sources.item_list``.
    """
    from colophon.functions.codes import blank_to_null

    item = lambda p: F.col(f"item.{p}")
    out = items.withColumns(
        {
            "external_product_id": F.coalesce(blank_to_null(item("content_id")), blank_to_null(item("product_id"))),
            "product_code": F.upper(blank_to_null(item("product_id"))),
            "release_date": F.replace(F.substring(blank_to_null(item("date")), 1, 10), F.lit("/"), F.lit("-")),
            "review": review_signal(item("review.count").try_cast("double"), item("review.average").try_cast("double")),
            "rank_position": F.col("position") if sort == "rank" else F.lit(None).cast("int"),
        }
    )
    out = out.withColumn("age_days", release_age_days("release_date", as_of))
    provenance = F.struct(
        F.col("raw").alias("raw_payload"), F.lit(sort).alias("raw_source_sort"),
        F.col("position").alias("raw_source_position"), payload_hash("raw").alias("payload_hash"),
    )
    return out.select(
        "product_code", code_key_upper("product_code").alias("code_key"), "external_product_id", "release_date", "age_days",
        age_bucket("age_days").alias("age_bucket"),
        blank_to_null(F.try_element_at(item("iteminfo.maker"), F.lit(1))["name"]).alias("maker"),
        blank_to_null(F.try_element_at(item("iteminfo.series"), F.lit(1))["name"]).alias("series"),
        F.array(F.lit(sort)).alias("query_sorts"), "rank_position",
        F.when(F.col("rank_position").isNull(), "NONE").otherwise(F.concat(F.lit("rank:"), F.col("rank_position").cast("string"))).alias("popularity_signal"),
        F.col("review.label").alias("review_signal"),
        priority_score("age_days", "rank_position", F.col("review.score")).alias("priority_score"),
        F.coalesce(blank_to_null(item("imageURL.large")), blank_to_null(item("imageURL.list"))).alias("image_url"),
        F.lit(False).alias("already_exists"), F.array().cast("array<string>").alias("reason"),
        F.create_map(F.lit(sort), provenance).alias("provenance"),
    )


def reply_rows(requests: DataFrame, works: DataFrame, existing: DataFrame, site: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(new replies, repeats, unknown codes)``; ``requests(request_id, post_id, code)``.

    A request key already answered, stored or earlier in the batch, is a repeat.
    """
    code = F.upper(F.trim("code"))
    key = F.when(F.col("post_id").isNotNull(), F.concat(F.lit("post:"), "post_id")).otherwise(
        F.concat(F.lit("manual:"), F.sha2(F.concat_ws(":", code, F.coalesce("request_id", F.lit(""))), 256))
    )
    keyed = requests.filter(F.trim("code") != "").withColumn("request_key", key).withColumn("code_key", code_key_upper("code"))
    repeats = keyed.join(existing.select("request_key").distinct(), "request_key", "left_semi").select("request_key", "code")
    fresh = keyed.join(existing.select("request_key"), "request_key", "left_anti")
    fresh = latest_per_key(fresh, ["request_key"], [("code", "asc")])
    known = works.filter("is_published").select(code_key_upper("product_code").alias("code_key"), "id", "product_code", "performer")
    known = latest_per_key(known, ["code_key"], [("id", "asc")])
    found = fresh.join(known, "code_key")
    url = F.concat(F.lit(site + "/work/"), F.url_encode("product_code"))
    text = F.concat_ws("\n", F.concat(F.lit("品番："), "product_code"), F.concat(F.lit("女優："), F.coalesce("performer", F.lit("不明"))), F.lit("他の作品・類似作品はこちら"), url)
    replies = found.select("request_key", "product_code", text.alias("reply_text"), url.alias("url"))
    return replies, repeats, fresh.join(known, "code_key", "left_anti").select("request_key", "code")


def valid_events(events: DataFrame) -> DataFrame:
    """Events with well-formed ids that are no self-clicks; bad sessions nulled.

    Missing columns (``related_work_id``, ``product_code`` ...) are fine.
    """
    out = events
    if "work_id" in out.columns:
        out = out.filter(F.col("work_id").rlike(K.LOOSE_ID_PATTERN))
    if "related_work_id" in out.columns:
        out = out.filter(F.col("related_work_id").rlike(K.LOOSE_ID_PATTERN) & (F.col("related_work_id") != F.col("work_id")))
    if "product_code" in out.columns:
        out = out.withColumn("product_code", F.upper("product_code"))
    if "session_id" in out.columns:
        out = out.withColumn("session_id", F.when(F.col("session_id").rlike(K.SESSION_PATTERN), F.col("session_id")))
    return out


def resume_since(df: DataFrame, key: str, since) -> tuple[DataFrame, DataFrame]:
    """Rows after the saved id, and the next id to save."""
    rows = df if since is None else df.filter(F.col(key) > F.lit(since))
    newest = rows.agg(F.coalesce(F.max(key), F.lit(since)).alias("newest"), F.count("*").alias("fetched"))
    return rows, newest


def resume_batches(rows: DataFrame, position: str, processed: int, batch_size: int) -> DataFrame:
    """Rows not processed yet with their batch number; positions start at 0."""
    rest = rows.filter(F.col(position) >= processed)
    return rest.withColumn("batch", F.floor((F.col(position) - processed) / batch_size).cast("bigint"))


def offset_check(rows: DataFrame, position: str, processed: int) -> DataFrame:
    """Whether the rest starts where the job stopped: ``already_done``, ``ok`` or ``gap``."""
    first = F.min(position)
    state = F.when(first.isNull() | (F.max(position) < processed), "already_done").when(first > processed, "gap").otherwise("ok")
    return rows.agg(state.alias("state"), F.count_if(F.col(position) >= processed).alias("remaining"))


JOB_COUNTERS = ("processed", "imported", "updated", "failed", "duplicates")
JOB_SCHEMA = "fingerprint string, mode string, status string, " + ", ".join(f"{c} long" for c in JOB_COUNTERS)


def advance_jobs(jobs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(jobs, replies)`` after one chunk of each of some jobs, keyed by file fingerprint and mode.

    ``chunks(fingerprint, mode, offset, processed, imported, updated, failed, duplicates)`` has the
    counters of the chunk.  A chunk counts if it starts where its job stands; a new job stands at 0.
    One before that is ``already_processed`` and one after it a ``gap``: neither changes the job.  A
    reply has the state, the offset expected next and the cumulative counters.
    """
    keys = ["fingerprint", "mode"]
    stood = jobs.select(*keys, *[F.col(c).alias(f"_{c}") for c in JOB_COUNTERS])
    j = chunks.join(stood, keys, "left").withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(0)) for c in JOB_COUNTERS})
    state = F.when(F.col("offset") < F.col("_processed"), "already_processed").when(F.col("offset") > F.col("_processed"), "gap").otherwise("ok")
    j = j.withColumn("state", state)
    after = [(F.col(f"_{c}") + F.when(F.col("state") == "ok", F.col(c)).otherwise(0)).alias(c) for c in JOB_COUNTERS]
    replies = j.select(*keys, "offset", "state", *after).withColumn("expected_offset", F.col("processed"))
    moved = replies.filter("state = 'ok'").select(*keys, F.lit("processing").alias("status"), *JOB_COUNTERS)
    return jobs.join(moved.select(*keys), keys, "left_anti").unionByName(moved), replies


class ImportJobs:
    """Import jobs in a versioned table: a step is applied to the version it has read, or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, JOB_SCHEMA)

    def chunk(self, chunks: DataFrame) -> DataFrame:
        """Applies chunks and returns the replies; ``Conflict`` if another importer was quicker."""
        base = self.table.current()
        jobs, replies = advance_jobs(self.table.at(base), reuse(chunks, "chunks"))
        replies = reuse(replies, "replies")
        self.table.replace(jobs, base)
        return replies

    def finish(self, fingerprint: str, mode: str, status: str = "completed") -> None:
        """Marks a job ``completed`` or ``failed``; a failed one goes on where it stood with its next chunk."""
        base = self.table.current()
        mine = (F.col("fingerprint") == fingerprint) & (F.col("mode") == mode)
        self.table.replace(self.table.at(base).withColumn("status", F.when(mine, status).otherwise(F.col("status"))), base)

    def read(self) -> DataFrame:
        return self.table.read()
