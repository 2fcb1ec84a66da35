"""The scalar keys as temporary SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from colophon import constants as K


def register_functions(spark: SparkSession) -> None:
    name_drop = K.NAME_KEY_DROP.replace("\\", "\\\\")
    statements = (
        "code_key_lower(c STRING) RETURNS STRING RETURN lower(regexp_replace(c, '[^a-zA-Z0-9]', ''))",
        "code_key_upper(c STRING) RETURNS STRING RETURN "
        "nullif(regexp_replace(upper(trim(c)), '[^A-Z0-9]', ''), '')",
        f"name_key(c STRING) RETURNS STRING RETURN lower(regexp_replace(coalesce(c, ''), '{name_drop}', ''))",
        "trigram_set(c STRING) RETURNS ARRAY<STRING> RETURN array_distinct(flatten(transform("
        "filter(split(lower(coalesce(c, '')), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> ''), "
        "w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    )
    for statement in statements:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + statement)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION trigram_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN size(array_union(trigram_set(a), trigram_set(b))) = 0 THEN 0D ELSE "
        "size(array_intersect(trigram_set(a), trigram_set(b))) / "
        "size(array_union(trigram_set(a), trigram_set(b))) END"
    )
