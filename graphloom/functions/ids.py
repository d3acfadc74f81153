"""Ids derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(prefix: str, raw: Column, digits: int = 12) -> Column:
    """prefix_ and the first hex digits of the SHA-256 of ``raw``."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(raw, 256), 1, digits))


def joined_id(prefix: str, *parts: Column) -> Column:
    return short_id(prefix, F.concat_ws("|", *parts), 16)


def content_hash(*columns: Column) -> Column:
    """24 hex digits over the canonical JSON of the columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24)


def chunk_id(index: Column, text: Column, document: Column) -> Column:
    return F.concat(F.lit("chunk_"), index.cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", document, index.cast("string"), text), 256), 1, 12))
