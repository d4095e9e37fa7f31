"""Identifier expressions: composing them, and cleaning those of referring fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as surrounding white space of an id.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}"


def clean_id(ref: Column) -> Column:
    """Trimmed of all white space (Unicode too) and in lower case; null for null and blank."""
    trimmed = F.lower(F.regexp_replace(ref, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(trimmed != "", trimmed)


def view_id(source: Column, channel: Column) -> Column:
    """``<source>/target-chCC``; null when either part is null."""
    return F.when(source.isNotNull() & channel.isNotNull(), F.format_string("%s/target-ch%02d", source, channel))


def event_id(source: Column, channel: Column, ordinal: Column) -> Column:
    """``<source>/chCC/eventNNNN``; null when any part is null."""
    known = source.isNotNull() & channel.isNotNull() & ordinal.isNotNull()
    return F.when(known, F.format_string("%s/ch%02d/event%04d", source, channel, ordinal))


def window_index(prefix: str, source: Column, channel: Column, lo: Column, hi: Column) -> Column:
    """``<prefix>__<source>__chCC__cNNNNNN-NNNNNN``."""
    return F.format_string(f"{prefix}__%s__ch%02d__c%06d-%06d", source, channel, lo, hi)
