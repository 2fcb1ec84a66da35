"""Catalog CSV: reading under Japanese or English headers, and row validation."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colophon import constants as K
from colophon.functions.codes import blank_to_null
from colophon.functions.dates import DATE_SHAPE
from colophon.functions.urls import HTTP_PATTERN
from colophon.operators.ranking import numbered
from colophon.session import reuse

NUMBERS = ("duration", "popularity", "favorite_count")
URLS = ("card_image_url", "image_url", "video_url", "affiliate_url")
TEXTS = ("title", "performer", "maker", "series", "label", "description")


def header_name(raw: str) -> str:
    name = raw.replace("﻿", "").strip().lower()
    return K.CSV_HEADER_NAMES.get(name, name)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV records as texts, line breaks in quoted fields included: ``_file, _block, _line, record``.

    A line break ends a record if an even number of quotes stands before it in the file.  Every
    split of a file counts its quotes, the splits before it give the parity at its beginning, and so
    each knows its records without the text of another.  Only records of several lines are put
    together by a shuffle.  Fields with quotes must be quoted, as the format asks.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
    )
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
    lines = lines.withColumn("_quotes", quotes)
    # one row a split
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda df, c: df.groupBy("_file", "_block").agg(F.sum(c).alias("_n")).select("_file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_file", "_block").orderBy("_line")
    upto = F.coalesce(F.sum("_quotes").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = lines.join(before(lines, "_quotes"), ["_file", "_block"]).withColumn("_start", ((F.col("_before") + upto) % 2 == 0).cast("int")).drop("_before")
    opened = reuse(opened, "lines")
    alone = (F.col("_start") == 1) & (F.col("_quotes") % 2 == 0)
    single = opened.filter(alone).select("_file", "_block", "_line", F.col("value").alias("record"))
    many = opened.join(before(opened, "_start"), ["_file", "_block"]).withColumn("_record", F.col("_before") + F.sum("_start").over(local)).filter(~alone)
    parts = F.array_sort(F.collect_list(F.struct("_block", "_line", "value")))  # the lines of one record
    joined = many.groupBy("_file", "_record").agg(parts.alias("p")).select("_file", F.col("p")[0]["_block"].alias("_block"), F.col("p")[0]["_line"].alias("_line"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(joined)


def _split_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows ``_0, _1 ...`` with their place, without the header of each file, and the header's names."""
    records = reuse(quoted_records(spark, path).filter(F.trim(F.regexp_replace("record", "^\ufeff", "")) != ""), "records")
    heads = records.groupBy("_file").agg(F.min(F.struct("_block", "_line", "record")).alias("h"))
    first = heads.orderBy("_file").select("h.record").first()
    if first is None:
        return spark.createDataFrame([], "_file string, _block bigint, _line bigint"), []
    names = next(csv.reader([first[0].rstrip("\r")], skipinitialspace=True))
    schema = ", ".join(f"`_{k}` string" for k in range(len(names)))
    body = records.join(heads.select("_file", F.col("h._block").alias("_hb"), F.col("h._line").alias("_hl")), "_file").filter((F.col("_block") != F.col("_hb")) | (F.col("_line") != F.col("_hl")))
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "multiLine": "true"}
    return body.withColumn("_r", F.from_csv(F.regexp_replace("record", "\r$", ""), schema, options)).select("_file", "_block", "_line", "_r.*"), names


def read_catalog_csv(spark: SparkSession, path: str, multiline: bool = True, split: bool = True) -> DataFrame:
    """All-text rows with the fixed columns and ``row`` (first data row is 2).

    Blank lines are skipped.  Large files are split even where fields hold line breaks; with
    ``split=False`` a file is one task, and quotes may stand in fields that are not quoted.
    ``multiline=False`` is for files in which no field holds a line break.
    """
    if multiline and split:
        raw, names = _split_rows(spark, path)
        chosen = {header_name(c): f"_{k}" for k, c in enumerate(names)}  # a later header of the same meaning wins
        place = [F.col(c) for c in ("_file", "_block", "_line")]
    else:
        raw = (
            spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", True).option("encoding", "UTF-8").csv(path)
        )
        chosen = {header_name(c): c for c in raw.columns}
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    rows = raw.select(*[(F.col(f"`{chosen[c]}`") if c in chosen else F.lit(None).cast("string")).alias(c) for c in K.CSV_COLUMNS], *place)
    present = F.coalesce(*[blank_to_null(c) for c in K.CSV_COLUMNS])
    rows = rows.filter(present.isNotNull())
    order = [("_file", "asc"), ("_block", "asc"), ("_line", "asc")]
    return numbered(rows, [], order, "row").withColumn("row", F.col("row") + 1).select(*K.CSV_COLUMNS, "row")


def _pipe_list(c: str) -> Column:
    parts = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _images() -> Column:
    raw = blank_to_null("sample_images")
    parsed = F.from_json(raw, "array<string>")
    items = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(raw.isNull(), None).when(raw.startswith("["), F.coalesce(items, _pipe_list("sample_images"))).otherwise(
        _pipe_list("sample_images")
    )


def check_rows(rows: DataFrame) -> DataFrame:
    """Typed row plus ``message``: the first rule a row breaks, or null."""
    names = {k.lower(): v for k, v in K.CSV_HEADER_NAMES.items()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    cleared = F.array_distinct(
        F.transform(_pipe_list("clear_fields"), lambda x: F.coalesce(lookup[F.lower(x)], F.lower(x)))
    )
    staged = rows.select(
        "row",
        F.upper(blank_to_null("product_code")).alias("product_code"),
        *[blank_to_null(c).alias(c) for c in (*TEXTS, *NUMBERS, *URLS, "release_date", "performer_kana")],
        _images().alias("sample_images"),
        _pipe_list("genre").alias("genres"),
        _pipe_list("tags").alias("tags"),
        cleared.alias("clear_fields"),
    )
    bad_number = [
        F.coalesce(~F.col(c).rlike("^[0-9]+$") | (F.col(c).try_cast("decimal(38,0)") > K.MAX_SAFE_INTEGER) | F.col(c).try_cast("decimal(38,0)").isNull(), F.lit(False))
        & F.col(c).isNotNull()
        for c in NUMBERS
    ]
    bad_clear = F.try_element_at(F.filter("clear_fields", lambda x: ~x.isin(*K.CSV_CLEARABLE)), F.lit(1))
    bad_url = F.exists(
        F.concat(F.array(*URLS), F.coalesce("sample_images", F.array().cast("array<string>"))),
        lambda u: F.coalesce(~u.rlike(HTTP_PATTERN), F.lit(False)),
    )
    message = (
        F.when(F.col("product_code").isNull(), K.CSV_MESSAGES["code"])
        .when(F.col("release_date").isNotNull() & ~F.col("release_date").rlike(DATE_SHAPE), K.CSV_MESSAGES["date"])
        .when(bad_number[0] | bad_number[1] | bad_number[2], K.CSV_MESSAGES["number"])
        .when(bad_clear.isNotNull(), F.concat(F.lit(K.CSV_CLEAR_MESSAGE[0]), bad_clear, F.lit(K.CSV_CLEAR_MESSAGE[1])))
        .when(bad_url, K.CSV_MESSAGES["url"])
    )
    return staged.withColumn("message", message)


def validate_catalog_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, errors)``; only the first broken rule of a row is reported."""
    checked = check_rows(rows)
    valid = checked.filter("message is null").select(
        "row", "product_code", *TEXTS, "performer_kana",
        F.try_element_at("genres", F.lit(1)).alias("genre"),
        *[F.col(c).try_cast("bigint").alias(c) for c in NUMBERS],
        "release_date", *URLS, "sample_images", "genres", "tags", "clear_fields",
        ((F.size("tags") > 0) | F.array_contains("clear_fields", "tags")).alias("tags_supplied"),
        ((F.size("genres") > 0) | F.array_contains("clear_fields", "genre")).alias("genres_supplied"),
    )
    return valid, checked.filter("message is not null").select("row", "product_code", "message")
