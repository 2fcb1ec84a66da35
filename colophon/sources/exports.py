"""Frozen manifests, wide candidate CSVs, sitemap files and table digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colophon.functions.hashing import stable_json


def write_frozen_jsonl(df: DataFrame, path: str, position: str = "position") -> None:
    """Lossless gzip JSON lines in position order; nulls are kept."""
    df.orderBy(position).write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def read_frozen_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns (all of them, unless named) with times as text, so that every engine writes them alike."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select(*[
        day(c).alias(c) if isinstance(kinds[c], T.DateType) else time(c).alias(c) if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType)) else F.col(c) for c in columns or df.columns
    ])


def row_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(F.sha2(stable_json(*(columns or df.columns)), 256).alias("digest"))


def _halves(digest: str) -> list[Column]:
    """Two 60-bit halves of a hash as exact decimals: equal tables add up to the same, and repeated rows count (which XOR would cancel out)."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)").alias(name) for at, name in ((1, "hi"), (16, "lo"))]


def _sums(rows: DataFrame, keys: list[str], count: Column, *more: Column) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.sum(c), zero).cast("decimal(38,0)").alias(c)
    return rows.groupBy(*keys).agg(count.alias("rows"), total("hi"), total("lo"), *more)


def _joined(sums: DataFrame, *columns: str) -> DataFrame:
    return sums.select(*columns, "rows", F.concat_ws(":", F.col("hi").cast("string"), F.col("lo").cast("string")).alias("digest"))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row ``rows, digest``: order-free, so no task has to see the whole table in order."""
    return _joined(_sums(row_digest(df, columns).select(*_halves("digest")), [], F.count("*")))


#: ranges of a level that make one of the next, and levels of a tree
TREE_FAN, TREE_LEVELS = 256, 3


def digest_tree(df: DataFrame, key: str, width: int = 1000, fan: int = TREE_FAN, levels: int = TREE_LEVELS) -> DataFrame:
    """Rows ``level, range, rows, digest`` of key ranges, level 0 the finest.

    Range r of level n has the keys from ``r * width * fan^n``; keys that are no whole numbers are
    dealt into 65,536 ranges of their hash.  A digest adds up those of the level below, so the rows
    are read once.  Null keys are range -1 of every level.
    """
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    place = F.floor(F.col(key) / width).cast("bigint") if whole else F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4), 16, 10).cast("bigint")
    plain = canonical(df.withColumn("_range", F.coalesce(place, F.lit(-1))))
    rows = plain.select(F.col("_range").alias("range"), F.sha2(stable_json(*df.columns), 256).alias("digest")).select("range", *_halves("digest"))
    sums = _sums(rows, ["range"], F.count("*"))
    out = []
    for level in range(levels):
        if level:
            sums = _sums(sums.withColumn("range", up), ["range"], F.sum("rows"))
        up = F.when(F.col("range") < 0, F.col("range")).otherwise(F.floor(F.col("range") / fan).cast("bigint"))
        out.append(_joined(sums.withColumn("parent", up).withColumn("level", F.lit(level)), "level", "range", "parent"))
    return reduce(DataFrame.unionByName, out)


def catalog_snapshot(tables: dict[str, DataFrame], published: str = "is_published") -> DataFrame:
    """Row count and digest over all columns of every table, and how many rows are published where a table says so."""
    parts = []
    for name, df in tables.items():
        flag = F.col(published) if published in df.columns else F.lit(None).cast("boolean")
        plain = canonical(df)
        rows = plain.select(F.sha2(stable_json(*plain.columns), 256).alias("digest"), flag.alias("_flag")).select(*_halves("digest"), "_flag")
        count = lambda yes: F.when(F.lit(published in df.columns), F.count_if(F.col("_flag") == F.lit(yes)))  # noqa: B023, E731
        sums = _sums(rows, [], F.count("*"), count(True).alias("published"), count(False).alias("unpublished"))
        parts.append(sums.select(F.lit(name).alias("table"), "rows", F.concat_ws(":", F.col("hi").cast("string"), F.col("lo").cast("string")).alias("digest"), "published", "unpublished"))
    return reduce(DataFrame.unionByName, parts)


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("table", F.col("rows").alias("rows_before"), F.col("digest").alias("digest_before"))
    a = after.select("table", F.col("rows").alias("rows_after"), F.col("digest").alias("digest_after"))
    return b.join(a, "table", "full_outer").withColumn("unchanged", F.col("digest_before").eqNullSafe(F.col("digest_after")))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """The finest ranges in which two digest trees differ: ``range, rows_before, rows_after``.

    The trees are compared from the top, and of each level only what lies in a changed range of the
    level above.  Stored trees are partitioned by level, so equal tables cost their top level.
    """
    found = None
    for level in range(TREE_LEVELS - 1, -1, -1):
        sides = []
        for tree, name in ((before, "before"), (after, "after")):
            side = tree.filter(F.col("level") == level).select("range", "parent", F.col("rows").alias(f"rows_{name}"), F.col("digest").alias(f"digest_{name}"))
            if found is not None:
                side = side.join(found.select(F.col("range").alias("parent")), "parent", "left_semi")
            sides.append(side.drop("parent"))
        both = sides[0].join(sides[1], "range", "full_outer")
        found = both.filter(~F.col("digest_before").eqNullSafe(F.col("digest_after"))).select("range", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))
    return found


def candidate_csv_rows(df: DataFrame, headers: list[str]) -> DataFrame:
    """Columns in the fixed order as text; structs, maps and arrays as JSON, null as blank."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    return df.select(
        *[F.coalesce(F.to_json(h) if h in nested else F.col(h).cast("string"), F.lit("")).alias(h) for h in headers]
    )


def export_candidates_csv(df: DataFrame, headers: list[str], path: str) -> None:
    candidate_csv_rows(df, headers).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"))


def write_sitemap(pages: DataFrame, path: str) -> None:
    """One folder per sitemap page with the page's ``<url>`` lines in order; ``pages(page, url, lastmod[, position])``."""
    escaped = F.col("url")
    for raw, safe in _XML:
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    line = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), F.coalesce("lastmod", F.lit("")), F.lit("</lastmod></url>"))
    place = [c for c in ("page", "position") if c in pages.columns]
    rows = pages.select(*place, line.alias("value")).repartition("page").sortWithinPartitions(*place)
    rows.select("page", "value").write.mode("overwrite").partitionBy("page").text(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``page, url, lastmod`` of written sitemap pages; a missing date is null."""
    url = F.regexp_extract("value", "<loc>(.*?)</loc>", 1)
    for raw, safe in reversed(_XML):
        url = F.replace(url, F.lit(safe), F.lit(raw))
    rows = spark.read.schema("value string, page bigint").text(path)
    return rows.select("page", url.alias("url"), F.nullif(F.regexp_extract("value", "<lastmod>(.*?)</lastmod>", 1), F.lit("")).alias("lastmod"))


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Rollups by period (or day), so that readers prune to the part they show."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


