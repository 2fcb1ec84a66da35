"""Product-code keys and name keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def code_key_lower(c) -> Column:
    """Search and import key: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(_col(c), "[^a-zA-Z0-9]", ""))


def code_key_upper(c, strict_reference: bool = False) -> Column:
    """Dedupe key: upper case first, then letters and digits only; empty becomes null.

    ``strict_reference`` strips before raising the case, so lower-case letters vanish;
    the result may then be the empty string, which equals other empty keys.
    """
    if strict_reference:
        return F.upper(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Z0-9]", ""))
    return F.nullif(F.regexp_replace(F.upper(F.trim(_col(c))), "[^A-Z0-9]", ""), F.lit(""))


def display_code(c) -> Column:
    """Upper case without white space; blank becomes null."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(_col(c))), "\\s+", ""), F.lit(""))


def canonical_code(c, aliases: dict[str, str] | None = None, rejected=None) -> Column:
    """Struct ``original, display, canonical, key, alias_applied, rejected, reason``.

    The alias and rejection lists are short settings, so they are literals in the plan;
    for a long alias table join on ``display_code`` instead.
    """
    aliases = K.CODE_ALIASES if aliases is None else aliases
    rejected = K.REJECTED_CODES if rejected is None else rejected
    display = display_code(c)
    is_rejected = F.coalesce(display.isin(*rejected), F.lit(False)) if rejected else F.lit(False)
    mapped = display
    for old, new in aliases.items():
        mapped = F.when(display == old, F.lit(new)).otherwise(mapped)
    canonical = F.when(~is_rejected, mapped)
    return F.struct(
        blank_to_null(c).alias("original"),
        display.alias("display"),
        canonical.alias("canonical"),
        F.nullif(F.regexp_replace(canonical, "[^A-Z0-9]", ""), F.lit("")).alias("key"),
        F.coalesce(canonical != display, F.lit(False)).alias("alias_applied"),
        is_rejected.alias("rejected"),
        F.when(is_rejected, F.lit(K.CODE_REJECTION_REASON)).alias("reason"),
    )


def hyphenate_code(c) -> Column:
    """``ABC123`` -> ``ABC-123``; anything else stays as it is."""
    return F.regexp_replace(_col(c), "^([A-Za-z]+)([0-9]+)$", "$1-$2")


def name_key(c) -> Column:
    """Lower-cased name without white space, dashes, dots and slashes."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), K.NAME_KEY_DROP, ""))
