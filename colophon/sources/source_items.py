"""Candidate items: closed-schema JSON intake, insert-ignore, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colophon import constants as K
from colophon.functions.codes import blank_to_null
from colophon.functions.urls import HTTP_PATTERN
from colophon.operators.ranking import latest_per_key

ITEM_SCHEMA = (
    "source string, source_key string, source_url string, observed_at string, product_code string, title string, "
    "performer string, maker string, series string, tags array<string>, payload string, _corrupt_record string"
)
OPTIONAL = ("source_url", "product_code", "title", "performer", "maker", "series")


def read_source_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the closed schema; unreadable lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(ITEM_SCHEMA).option("mode", "PERMISSIVE").json(path)


def check_source_items(items: DataFrame, observed_at: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by length and shape; accepted rows are pending candidates."""
    trimmed = items
    for c in ("source", "source_key", *OPTIONAL):
        trimmed = trimmed.withColumn(c, F.trim(c))
    tag_count, tag_length = K.ITEM_TAG_LIMITS
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.trim(x))
    trimmed = trimmed.withColumn("tags", tags)
    ok = F.coalesce(F.length("source").between(1, K.ITEM_LENGTH_LIMITS["source"]), F.lit(False))
    ok = ok & F.coalesce(F.length("source_key").between(1, K.ITEM_LENGTH_LIMITS["source_key"]), F.lit(False))
    for c in OPTIONAL:
        ok = ok & F.coalesce(F.length(c) <= K.ITEM_LENGTH_LIMITS[c], F.lit(True))
    ok = ok & F.coalesce(F.col("source_url").rlike(HTTP_PATTERN), F.lit(True))
    ok = ok & (F.size("tags") <= tag_count) & F.forall("tags", lambda x: F.length(x).between(1, tag_length))
    if "_corrupt_record" in items.columns:
        ok = ok & F.col("_corrupt_record").isNull()
    rejected = trimmed.filter(~ok)
    accepted = trimmed.filter(ok).drop("_corrupt_record")
    for c in OPTIONAL:
        accepted = accepted.withColumn(c, blank_to_null(c))
    accepted = accepted.withColumn("product_code", F.upper("product_code")).withColumn("status", F.lit("pending"))
    return accepted.withColumn("observed_at", F.coalesce("observed_at", F.lit(observed_at))), rejected


def ingest_source_items(existing: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Insert-ignore on (source, source_key): ``(new rows, accepted/duplicates counts)``.

    Of repeated keys in a batch the first by ``order`` is kept.
    """
    keys = ["source", "source_key"]
    first = latest_per_key(batch, keys, [(order, "asc")])
    fresh = first.join(existing.select(*keys).distinct(), keys, "left_anti")
    total = batch.agg(F.count("*").alias("n")).scalar()
    counts = fresh.agg(F.count("*").alias("accepted")).withColumn("duplicates", total - F.col("accepted"))
    return fresh, counts


def export_source_items(items: DataFrame, path: str) -> None:
    """Quoted CSV in id order: line breaks become blanks, tags are joined with a pipe."""
    export_rows(items).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).option("lineSep", "\n").csv(path)


def export_rows(items: DataFrame) -> DataFrame:
    """The exported text columns, sorted by id across the output files."""
    def flat(c: str):
        column = F.array_join(F.col(c), "|") if c == "tags" else F.col(c).cast("string")
        return F.regexp_replace(F.coalesce(column, F.lit("")), "[\\r\\n]+", " ").alias(c)

    return items.orderBy("id").select(*[flat(c) for c in K.ITEM_EXPORT_COLUMNS])
