"""Release age, freshness and the review signal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.codes import _col

DATE_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def release_age_days(released, as_of: str) -> Column:
    """Whole days between a ``yyyy-MM-dd`` text and the as-of day, at least 0; null for anything else."""
    text = F.trim(_col(released))
    day = F.when(text.rlike(DATE_SHAPE), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), day)))


def age_bucket(age) -> Column:
    a = _col(age)
    return (
        F.when(a.isNull(), "UNKNOWN")
        .when(a <= 7, "0-7d")
        .when(a <= 30, "8-30d")
        .when(a <= 90, "31-90d")
        .when(a <= 180, "91-180d")
        .otherwise("180+d")
    )


def freshness_score(age) -> Column:
    """Newer works score higher, with a step at each bucket edge."""
    a = _col(age)
    return (
        F.when(a.isNull(), F.lit(-1000))
        .when(a <= 7, 1000 - 2 * a)
        .when(a <= 30, 850 - a)
        .when(a <= 90, 650 - a)
        .when(a <= 180, 400 - a)
        .otherwise(-a)
    )


def review_signal(count, average) -> Column:
    """Struct ``count, average, label, score``; out-of-range reviews give ``NONE`` and 0."""
    n, avg = _col(count).cast("double"), _col(average).cast("double")
    ok = F.coalesce((n >= 0) & (avg >= 0) & (avg <= 5), F.lit(False))
    shown = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.struct(
        F.when(ok, n).alias("count"),
        F.when(ok, avg).alias("average"),
        F.when(ok, F.concat(F.lit("count:"), shown, F.lit(";average:"), F.format_string("%.2f", avg)))
        .otherwise("NONE")
        .alias("label"),
        F.when(ok, F.least(n, F.lit(100.0)) + F.floor(avg * 10 + 0.5)).otherwise(0.0).alias("score"),
    )


def priority_score(age, rank_position, review_score) -> Column:
    rank = F.when(_col(rank_position).isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(0), 600 - _col(rank_position))
    )
    return (freshness_score(age) + rank + _col(review_score)).cast("double")
