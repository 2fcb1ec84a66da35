"""Joins on keys that many rows lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: rows without a key are dealt into so many parts
DEALT = 4096


def by_key(other: DataFrame) -> DataFrame:
    """The right side of a join, told to be sorted by its key rather than sent whole to driver and tasks.

    Spark guesses the size of derived rows from the files they come from, so a table of many rows
    made of a few columns would be broadcast.
    """
    return other.hint("merge")


def lookup(df: DataFrame, other: DataFrame, key: str, how: str = "left", spread: list[Column] | None = None) -> DataFrame:
    """Join with ``other`` on a key that may be null in a large share of the rows of ``df``.

    A left join sends all rows without a key to one task; here a second join column, zero where
    there is a key, deals them by ``spread`` (all columns that can be hashed, unless given).
    """
    by = spread or [F.col(f"`{c}`") for c, kind in df.dtypes if c != key and not kind.startswith(("map", "variant")) and "map<" not in kind]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*(by or [F.lit(0)])), F.lit(DEALT))).otherwise(F.lit(0)).cast("int")
    # always zero, but not a constant that the optimizer would take out of the join
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    right = other.filter(F.col(key).isNotNull()).withColumn("_dealt", zero)
    return df.withColumn("_dealt", salt).join(right, [key, "_dealt"], how).drop("_dealt")
