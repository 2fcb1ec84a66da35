"""Stable hashes of rows and payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.codes import _col


def payload_hash(c) -> Column:
    """SHA-256 of a payload text.  Key order matters, so hash the raw text, not a parsed struct."""
    return F.sha2(_col(c), 256)


def stable_json(*columns: str) -> Column:
    """JSON object with its keys in alphabetical order; nulls are written out."""
    fields = [F.col(c).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def metadata_hash(*columns: str) -> Column:
    return F.sha2(stable_json(*columns), 256)
