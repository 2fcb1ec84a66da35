"""Candidate triage, reviewer actions and review-quality measurement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colophon import constants as K
from colophon.operators.ranking import latest_per_key, top_rows
from colophon.operators.staging import find_candidate_duplicates

EDITABLE = ("product_code", "title", "performer", "maker", "series")


@dataclass(frozen=True)
class QualitySettings:
    high: float = K.QUALITY_DEFAULTS["high"]
    medium: float = K.QUALITY_DEFAULTS["medium"]
    auto_approve: float = K.QUALITY_DEFAULTS["auto_approve"]
    auto_approve_enabled: bool = False
    min_samples: int = K.QUALITY_DEFAULTS["min_samples"]
    min_precision: float = K.QUALITY_DEFAULTS["min_precision"]

    def __post_init__(self):
        if not 0 <= self.medium <= self.high <= self.auto_approve <= 1:
            raise ValueError("thresholds must satisfy 0 <= medium <= high <= auto_approve <= 1")


def review_bucket(confidence: Column, duplicate: Column, code: Column, title: Column, s: QualitySettings) -> Column:
    return (
        F.when(duplicate, "duplicate").when(~code | ~title, "invalid").when(confidence >= s.high, "high")
        .when(confidence >= s.medium, "medium").otherwise("low")
    )


def _present(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def triage_candidates(items: DataFrame, works: DataFrame, settings: QualitySettings, gate_passed: bool) -> DataFrame:
    """Bucket of every candidate, with its duplicates; sure ones are approved when the gate is open."""
    found = find_candidate_duplicates(items.select("id", "status", "product_code"), works)
    j = items.join(found, "id", "left")
    duplicate = F.col("duplicate_of").isNotNull() | F.col("duplicate_work_id").isNotNull()
    code, title = _present("product_code"), _present("title")
    bucket = review_bucket(F.col("confidence"), duplicate, code, title, settings)
    if settings.auto_approve_enabled and gate_passed:
        sure = ~duplicate & code & title & (F.col("confidence") >= settings.auto_approve)
        bucket = F.when(sure, "auto_approved").otherwise(bucket)
    return j.withColumn("review_bucket", bucket)


def quality_snapshot(items: DataFrame, corrections: DataFrame, settings: QualitySettings, all_models: bool = False) -> DataFrame:
    """Approval, correction and precision figures of the model with most reviewed candidates.

    The latest approved or rejected decision of a candidate counts.
    """
    decided = corrections.filter("decision in ('approved','rejected')")
    latest = decided.groupBy("item_id").agg(F.max_by("decision", "decided_at").alias("decision"))
    corrected = corrections.filter("decision = 'corrected'").select("item_id").distinct().withColumn("_corrected", F.lit(True))
    rows = items.join(latest, items.id == latest.item_id).drop("item_id")
    rows = rows.join(corrected, rows.id == corrected.item_id, "left")
    high, yes = F.col("confidence") >= settings.high, F.col("decision") == "approved"
    stats = rows.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.count("*").alias("sample_count"), F.count_if(yes).alias("approved_count"), F.count_if(~yes).alias("rejected_count"),
        F.count_if(F.coalesce("_corrected", F.lit(False))).alias("corrected_count"), F.avg("confidence").alias("average_confidence"),
        F.count_if(yes & high).alias("_ha"), F.count_if(high).alias("_ht"),
    )
    precision = F.when(F.col("_ht") > 0, F.col("_ha") / F.col("_ht"))
    out = stats.select(
        "model", "sample_count", "approved_count", "rejected_count", "corrected_count",
        (F.col("approved_count") / F.nullif(F.col("approved_count") + F.col("rejected_count"), F.lit(0))).alias("approval_rate"),
        (F.col("corrected_count") / F.col("sample_count")).alias("correction_rate"), "average_confidence",
        precision.alias("high_confidence_precision"),
        ((F.col("sample_count") >= settings.min_samples) & (F.coalesce(precision, F.lit(0.0)) >= settings.min_precision)).alias("passed_gate"),
    )
    return out if all_models else top_rows(out, [("sample_count", "desc"), ("model", "asc")], 1)


def operations_metrics(items: DataFrame, runs: DataFrame, clicks: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Totals of intake, review and extraction with their rates, in one row.

    ``items(status, product_code, duplicate_of, duplicate_work_id, extraction_status)``,
    ``runs(status, input_tokens, output_tokens)``.  The click-through rate is clicks by candidates,
    the decided rates are shares of approved and rejected items.  ``tables`` are counted under their names.
    """
    i = items.agg(
        F.count("*").alias("collected"), F.count("product_code").alias("candidates"), F.count_if(F.col("status") == "promoted").alias("approved"),
        F.count_if(F.col("status") == "ignored").alias("rejected"),
        F.count_if(F.col("duplicate_of").isNotNull() | F.col("duplicate_work_id").isNotNull()).alias("duplicates"),
        F.count_if((F.col("status") == "error") | (F.col("extraction_status") == "failed")).alias("_item_errors"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    r = runs.agg(
        F.count("*").alias("ai_requests"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count_if(F.col("status") == "failed").alias("_run_errors"),
    )
    c = clicks.agg(F.count("*").alias("affiliate_clicks"))
    row = i.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c))  # one row each
    for name, df in (tables or {}).items():
        row = row.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    row = row.withColumn("_decided", F.col("approved") + F.col("rejected"))
    return row.withColumn("errors", F.col("_item_errors") + F.col("_run_errors")).withColumns(
        {"approval_rate": rate("approved", "candidates"), "rejection_rate": rate("rejected", "candidates"), "duplicate_rate": rate("duplicates", "candidates"),
         "decided_approval_rate": rate("approved", "_decided"), "decided_rejection_rate": rate("rejected", "_decided"), "click_through_rate": rate("affiliate_clicks", "candidates")}
    ).drop("_item_errors", "_run_errors", "_decided")


def open_review_queue(items: DataFrame, bucket: str | None = None, limit: int | None = None) -> DataFrame:
    """Pending candidates by bucket, surest first, newest first."""
    rows = items.filter("status = 'pending'")
    if bucket is not None:
        rows = rows.filter(F.col("review_bucket") == bucket)
    order = [("review_bucket", "asc"), ("confidence", "desc"), ("observed_at", "desc"), ("id", "asc")]
    if limit is not None:
        return top_rows(rows, order, limit)
    return rows.orderBy("review_bucket", F.col("confidence").desc_nulls_last(), F.col("observed_at").desc_nulls_last(), "id")


def release_stale(items: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """Extractions stuck in ``processing`` for longer than ``minutes`` become ``failed``."""
    stale = (F.col("extraction_status") == "processing") & (F.col("updated_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes"))
    return items.withColumn("extraction_status", F.when(stale, "failed").otherwise(F.col("extraction_status")))


def queue_head(items: DataFrame, n: int = 20) -> DataFrame:
    """Next candidates to extract, lowest id first."""
    rows = items.filter("status = 'pending' and extraction_status in ('pending','failed')")
    return top_rows(rows, [("id", "asc")], n)


def apply_review(items: DataFrame, actions: DataFrame, works: DataFrame, settings: QualitySettings) -> dict[str, DataFrame]:
    """Apply reviewer actions: ``actions(id, action, product_code, title, ...)``, one per item.

    ``save`` edits the given fields (null = leave, blank = clear) and re-triages; ``promote``
    needs code and title, else the item is an error; ``ignore`` rejects.  Every decision also
    yields a correction row.
    """
    edits = [F.col(c).alias(f"_{c}") for c in EDITABLE]
    act = actions.select("id", "action", *edits)
    j = items.join(act, "id", "left")
    new = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.nullif(F.trim(f"_{c}"), F.lit(""))) for c in EDITABLE}
    new["product_code"] = F.upper(new["product_code"])
    differs = lambda c: F.coalesce(c, F.lit(""))
    changed = F.array_compact(F.array(*[F.when(differs(F.col(c)) != differs(new[c]), F.lit(c)) for c in EDITABLE]))
    edited = j.withColumn("changed_fields", F.when(F.col("action").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    edited = edited.select(*[new[c].alias(c) if c in EDITABLE else F.col(c) for c in items.columns], "action", "changed_fields")
    found = find_candidate_duplicates(edited.select("id", "status", "product_code"), works)
    k = edited.join(found.select("id", F.col("duplicate_of").alias("_d"), F.col("duplicate_work_id").alias("_w")), "id", "left")
    retriaged = review_bucket(F.coalesce("confidence", F.lit(0.0)), F.col("_d").isNotNull() | F.col("_w").isNotNull(), _present("product_code"), _present("title"), settings)
    complete = _present("product_code") & _present("title")
    pending = F.col("status") == "pending"
    status = (
        F.when(F.col("action") == "ignore", "ignored").when((F.col("action") == "promote") & pending & complete, "promoted")
        .when((F.col("action") == "promote") & pending, "error").otherwise(F.col("status"))
    )
    decision = (
        F.when(F.col("action") == "ignore", "rejected").when((F.col("action") == "promote") & pending & complete, "approved")
    )
    bucket = F.col("review_bucket") if "review_bucket" in items.columns else F.lit(None).cast("string")
    out = k.withColumns({"_status": status, "_decision": decision, "review_bucket": F.when(F.size("changed_fields") > 0, retriaged).otherwise(bucket)})
    next_items = out.select(*[F.col("_status").alias("status") if c == "status" else F.col(c) for c in items.columns if c != "review_bucket"], "review_bucket")
    log = out.filter("action is not null").select(
        F.col("id").alias("item_id"), "changed_fields",
        F.explode(F.array_compact(F.array(F.when(F.size("changed_fields") > 0, "corrected"), F.col("_decision")))).alias("decision"),
    )
    promoted = out.filter("_decision = 'approved'").select("product_code", "title", "performer", "maker", "series")
    # an existing work of the same code stays as it is
    fresh = latest_per_key(promoted, ["product_code"], [("title", "asc")]).join(works.select("product_code"), "product_code", "left_anti")
    return {"items": next_items, "corrections": log, "new_works": fresh, "errors": out.filter("_status = 'error' and action = 'promote'").select("id")}
