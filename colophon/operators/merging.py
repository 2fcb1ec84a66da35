"""Upserts, change logs, dimensions and bridges.

Plain files have no MERGE.  Every merge here is a pure function from (stored, incoming) to
the next full table; ``overwrite_table`` swaps it in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colophon.functions.codes import name_key
from colophon.operators.ranking import latest_per_key
from colophon.sources.versioned import VersionedTable

CATALOG_FIELDS = (
    "title", "performer", "maker", "series", "label", "genre", "duration", "release_date", "sample_images",
    "card_image_url", "image_url", "video_url", "affiliate_url", "description", "popularity", "favorite_count",
)


def merge_into(target: DataFrame, updates: DataFrame, keys: list[str], policy: str = "update") -> DataFrame:
    """``update``: incoming rows replace stored rows of the same key; ``ignore``: stored rows stay.

    ``updates`` holds one row per key.
    """
    if policy == "ignore":
        fresh = updates.join(target.select(*keys), keys, "left_anti")
        return target.unionByName(fresh, allowMissingColumns=True)
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def overwrite_table(df: DataFrame, path: str) -> None:
    """Make the rows the next version of a versioned table, in one write.

    The version before stays readable until the new one is whole, and for one change more, so a job
    may read the table it replaces, and one that dies leaves it as it was.  ``read_table`` reads it.
    """
    VersionedTable(df.sparkSession, path).replace(df)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``overwrite_table`` has written."""
    return VersionedTable(spark, path).read()


def changed_fields(fields: list[str], before: str = "before", after: str = "after") -> Column:
    """Names of the fields that differ, nulls compared as values."""
    return F.array_compact(
        F.array(*[F.when(~F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")), F.lit(c)) for c in fields])
    )


def change_log(before: DataFrame, after: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """One row per changed record: changed field names and both versions as JSON."""
    b = before.select(key, F.struct(*fields).alias("before"))
    a = after.select(key, F.struct(*fields).alias("after"))
    both = b.join(a, key).withColumn("changed_fields", changed_fields(fields))
    keep_nulls = {"ignoreNullFields": "false"}
    return both.filter(F.size("changed_fields") > 0).select(
        key, "changed_fields", F.to_json("before", keep_nulls).alias("before_data"),
        F.to_json("after", keep_nulls).alias("after_data"), F.lit(source).alias("change_source"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keyed compare of two versions: ``added``, ``removed``, ``changed`` or ``same`` per key."""
    b = before.select(key, F.struct(*fields).alias("before"))
    a = after.select(key, F.struct(*fields).alias("after"))
    both = b.join(a, key, "full_outer")
    status = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    )
    return both.withColumn("status", status)


def update_where_changed(target: DataFrame, source: DataFrame, on: str, column: str, source_key: str, value: str) -> DataFrame:
    """Set ``column`` from a dimension row of the same name; ``changed`` marks real changes."""
    dim = source.select(F.col(source_key).alias("_k"), F.col(value).alias("_v"))
    joined = target.join(dim, target[on] == F.col("_k"), "left")
    changed = F.col("_k").isNotNull() & ~F.col(column).eqNullSafe(F.col("_v"))
    return joined.withColumn("changed", changed).withColumn(column, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_k", "_v")


def upsert_catalog_csv(existing: DataFrame, rows: DataFrame, mode: str = "skip") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(next catalog, outcome per row, change log)`` of validated CSV rows.

    Supplied fields overlay the stored work, ``clear_fields`` empty it.  A code repeated in
    the batch: every row is applied to the stored version, so the last row wins.
    """
    stored = existing.select("product_code", F.struct(*CATALOG_FIELDS, "is_published").alias("before"))
    joined = rows.join(stored, "product_code", "left")
    known = F.col("before").isNotNull()
    outcome = (
        F.when(known & F.lit(mode != "update"), "duplicate").when(known, "updated")
        .when(F.col("title").isNull(), "error").otherwise("imported")
    )
    defaults = {
        "sample_images": F.array().cast("array<string>"),
        "popularity": F.lit(0).cast("bigint"),
        "favorite_count": F.lit(0).cast("bigint"),
    }
    cleared = {**{c: F.lit(None) for c in CATALOG_FIELDS}, **defaults}
    next_fields = [
        F.when(F.array_contains("clear_fields", c), cleared[c]).otherwise(
            F.coalesce(F.col(c), F.col(f"before.{c}"), F.when(~known, defaults[c]) if c in defaults else F.lit(None))
        ).alias(c)
        for c in CATALOG_FIELDS
    ]
    result = joined.select(
        "row", "product_code", outcome.alias("outcome"), "before", *next_fields,
        F.coalesce("before.is_published", F.lit(False)).alias("is_published"),
        "genres", "tags", "clear_fields", "tags_supplied", "genres_supplied", "performer_kana",
    )
    written = result.filter("outcome in ('imported','updated')")
    winners = latest_per_key(written, ["product_code"], [("row", "desc")])
    catalog = merge_into(existing, winners.select("product_code", *CATALOG_FIELDS, "is_published"), ["product_code"])
    after = F.struct(*CATALOG_FIELDS, "is_published")
    log = written.filter("outcome = 'updated'").withColumn("after", after)
    log = log.withColumn("changed_fields", changed_fields([*CATALOG_FIELDS, "is_published"])).filter(F.size("changed_fields") > 0)
    log = log.select("row", "product_code", "changed_fields", F.to_json("before").alias("before_data"), F.to_json("after").alias("after_data"), F.lit("csv").alias("change_source"))
    return catalog, result, log


def import_job_report(outcomes: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of an import: processed, imported, updated, duplicate, failed."""
    rows = outcomes.select("outcome").unionByName(errors.select(F.lit("error").alias("outcome")))
    count = lambda v: F.count_if(F.col("outcome") == v)
    return rows.agg(
        F.count("*").alias("processed"), count("imported").alias("imported"), count("updated").alias("updated"),
        count("duplicate").alias("duplicate"), count("error").alias("failed"),
    )


def dimension_key(kind, name) -> Column:
    """Stable id of a named entity, so that no sequence has to be shared between tasks."""
    return F.md5(F.concat(kind, F.lit(":"), name))


def sync_dimensions(works: DataFrame, work_tags: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``kind, dimension_id, name, parent_id`` of the performers, makers, series, genres and tags in use.

    A series gets the first known maker (by id) among its works.  With ``existing`` the stored
    rows stay, and only a missing maker is filled in.
    """
    kinds = ("performer", "maker", "series", "genre")
    pairs = works.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(k).alias("name"), F.when(F.lit(k == "series"), F.trim("maker")).alias("maker_name")) for k in kinds]))
    )
    if work_tags is not None:
        pairs = pairs.unionByName(work_tags.select(F.lit("tag").alias("kind"), F.trim("tag").alias("name"), F.lit(None).cast("string").alias("maker_name")))
    maker_id = F.when(F.col("maker_name") != "", dimension_key(F.lit("maker"), F.col("maker_name")))
    named = pairs.filter("name <> ''").groupBy("kind", "name").agg(F.min(maker_id).alias("parent_id"))
    fresh = named.select("kind", dimension_key(F.col("kind"), F.col("name")).alias("dimension_id"), "name", "parent_id")
    if existing is None:
        return fresh
    old = existing.select("kind", "name", F.col("dimension_id").alias("_id"), F.col("parent_id").alias("_parent"))
    merged = fresh.join(old, ["kind", "name"], "full_outer")
    return merged.select("kind", F.coalesce("_id", "dimension_id").alias("dimension_id"), "name", F.coalesce("_parent", "parent_id").alias("parent_id"))


def kana_aliases(rows: DataFrame) -> DataFrame:
    """Aliases from performer readings that differ from the name."""
    return rows.filter("performer is not null and performer_kana is not null and performer_kana <> performer").select(
        F.lit("performer").alias("entity_type"), F.col("performer").alias("canonical_name"),
        F.col("performer_kana").alias("alias"), name_key("performer_kana").alias("normalized_alias"),
    ).dropDuplicates(["entity_type", "normalized_alias", "canonical_name"])


def sync_bridges(existing: DataFrame, rows: DataFrame, key: str, values: str, supplied: str, mode: str, cleared: str) -> DataFrame:
    """Links of works to names: ``merge`` adds, ``replace`` (or a cleared field) drops the old first.

    ``existing(key, name)``; rows that neither supply nor clear the field leave links alone.
    """
    touched = rows.filter(supplied)
    dropped = touched if mode == "replace" else touched.filter(F.array_contains("clear_fields", cleared))
    kept = existing.join(dropped.select(key).distinct(), key, "left_anti")
    added = touched.select(key, F.explode(values).alias("name"))
    return kept.unionByName(added).distinct()


def positions(df: DataFrame, key: str, names: str) -> DataFrame:
    """``key, name, position`` of a name list: distinct, the first place counts."""
    return df.select(key, F.posexplode(F.array_distinct(names)).alias("position", "name"))


def api_error_log(open_errors: DataFrame, new_errors: DataFrame, resolved_ids: DataFrame, stages: tuple[str, ...] = ("normalize", "deduplicate", "persist")) -> DataFrame:
    """Open errors after a step: a repeat raises the attempt count, a later success resolves.

    Key: job, offset, stage, type and id; ``resolved_ids(job_id, external_product_id)``.  Each of
    several new errors of one key counts as an attempt; the greatest message stays.
    """
    keys = ["job_id", "api_offset", "stage", "error_type", "external_product_id"]
    grouped = new_errors.groupBy(*keys).agg(F.count("*").alias("_times"), F.max("attempt_count").alias("attempt_count"), F.max("message").alias("message"))
    o, n = open_errors.alias("o"), grouped.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = o.join(n, on & F.col("o.resolved_at").isNull(), "full_outer")
    is_new = F.col("n.job_id").isNotNull()
    merged = both.select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys],
        F.when(is_new & F.col("o.job_id").isNotNull(), F.greatest(F.lit(0), F.coalesce("o.attempt_count", F.lit(0))) + F.col("n._times"))
        .when(is_new, F.greatest(F.lit(1), F.col("n.attempt_count")) + F.col("n._times") - 1).otherwise(F.col("o.attempt_count")).alias("attempt_count"),
        F.coalesce("n.message", "o.message").alias("message"),
        F.col("o.resolved_at").alias("resolved_at"),
    )
    done = resolved_ids.select("job_id", "external_product_id", F.col("resolved_at").alias("_done")).dropDuplicates(["job_id", "external_product_id"])
    out = merged.join(done, ["job_id", "external_product_id"], "left")
    now_resolved = F.col("stage").isin(*stages) & F.col("resolved_at").isNull()
    return out.withColumn("resolved_at", F.when(now_resolved, F.col("_done")).otherwise(F.col("resolved_at"))).drop("_done")


def fill_affiliate_url(works: DataFrame, template: str | None, affiliate_id: str | None, enabled: bool = True, batch: int | None = None) -> DataFrame:
    """Template link for works without one; ``batch`` fills only the first rows by id."""
    if not (enabled and template and affiliate_id):
        return works
    made = F.replace(F.replace(F.lit(template), F.lit("{product_code}"), F.col("product_code")), F.lit("{affiliate_id}"), F.lit(affiliate_id))
    if batch is None:
        return works.withColumn("affiliate_url", F.coalesce("affiliate_url", made))
    chosen = works.filter("affiliate_url is null").select("id").orderBy("id").limit(batch).withColumn("_fill", F.lit(True))
    out = works.join(chosen, "id", "left")
    return out.withColumn("affiliate_url", F.when(F.col("_fill"), made).otherwise(F.col("affiliate_url"))).drop("_fill")
