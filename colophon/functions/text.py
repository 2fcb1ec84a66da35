"""Text: trigram similarity, cleaning, redaction, labelled fields, key lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from colophon import constants as K
from colophon.functions.codes import _col


def trigrams(c) -> Column:
    """Set of the 3-grams of every alphanumeric word, padded two blanks left and one right."""
    words = F.filter(
        F.split(F.lower(F.coalesce(_col(c), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""
    )
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_overlap(a: Column, b: Column) -> Column:
    """Shared / all of two trigram sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def trigram_similarity(a, b) -> Column:
    return trigram_overlap(trigrams(a), trigrams(b))


def clean_query(text: str) -> str:
    """User query on the driver: list separators and wildcards become blanks, then trim."""
    return re.sub(r"[,%()]", " ", text or "").strip()


def number_or_null(c) -> Column:
    """Finite number or null."""
    n = _col(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


def redact(c, secrets: tuple[str, ...] = ()) -> Column:
    """Mask keys, tokens and the given secrets in a message."""
    out = F.regexp_replace(_col(c), "(?i)((?:api_id|affiliate_id|token|key|secret)=)[^&\\s]+", "$1[REDACTED]")
    out = F.regexp_replace(out, "(?i)(bearer\\s+)[a-z0-9._~+/=-]+", "$1[REDACTED]")
    for secret in secrets:
        if len(secret) >= 6:
            out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    return out


def labelled(c, labels: tuple[str, ...]) -> Column:
    """Value after ``label:`` up to a comma or line end, trimmed."""
    pattern = "(?i)(?:%s)[：:]\\s*([^\\n、,]+)" % "|".join(labels)
    return F.nullif(F.trim(F.regexp_extract(_col(c), pattern, 1)), F.lit(""))


# ASCII word boundary, so that accented letters count as outside characters
CODE_PATTERN = "(?<![A-Za-z0-9_])([A-Za-z]{2,12})[\\s_-]?([0-9]{2,8})(?![A-Za-z0-9_])"


def codes_in(c) -> Column:
    """Distinct ``ABC-123`` codes in a text, in order of appearance."""
    heads = F.regexp_extract_all(_col(c), F.lit(CODE_PATTERN), F.lit(1))
    tails = F.regexp_extract_all(_col(c), F.lit(CODE_PATTERN), F.lit(2))
    return F.array_distinct(F.zip_with(heads, tails, lambda h, t: F.concat(F.upper(h), F.lit("-"), t)))


def hashtags(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit("#([^\\s#]+)"), F.lit(1))


def json_keys(c) -> Column:
    """Every key at any depth of a JSON text, read off the text itself."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit('"((?:[^"\\\\]|\\\\.)*)"\\s*:'), F.lit(1)))


def forbidden_keys(c, pattern: str = K.PRIVATE_KEY_PATTERN) -> Column:
    return F.filter(json_keys(c), lambda k: k.rlike(pattern))


def unexpected_keys(c, allowed: tuple[str, ...] = (), pattern: str = K.PRIVATE_KEY_PATTERN) -> Column:
    """Keys that are neither private nor in the closed set."""
    return F.filter(
        json_keys(c),
        lambda k: ~k.rlike(pattern) & (~k.isin(*allowed) if allowed else F.lit(True)),
    )
