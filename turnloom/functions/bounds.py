"""Interval bounds: validity, rounding, and their place on the chunk grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest double within BIGINT: bounds further out count as this far out.
FARTHEST = 2.0**63 - 1024
CHUNK_MS = 160


def whole(bound: Column) -> Column:
    """A bound rounded (halves away from 0) to a BIGINT; null for null, NaN and infinite values.

    A finite bound outside of the BIGINT range is set to the nearest end of it.
    """
    x = bound.cast("double")
    near = F.least(F.greatest(x, F.lit(-FARTHEST)), F.lit(FARTHEST))
    return F.when(F.abs(x) < float("inf"), F.round(near).cast("bigint"))  # NaN compares as larger


def valid_pair(pair: Column) -> Column:
    """``struct<start, stop>`` of a two-element array with rounded bounds, null if it is no valid interval.

    Valid: the array and its first two elements are there, finite, and the
    rounded stop is greater than the rounded start. Further elements are ignored.
    """
    start, stop = whole(F.get(pair, F.lit(0))), whole(F.get(pair, F.lit(1)))
    return F.when(stop > start, F.struct(start.alias("start"), stop.alias("stop")))


def valid_pairs(pairs: Column) -> Column:
    """The valid intervals of an array of pairs; an empty array for null."""
    kept = F.filter(F.transform(pairs, valid_pair), lambda x: x.isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def chunk_range(start: Column, stop: Column, chunks: Column, chunk_ms: int = CHUNK_MS) -> tuple[Column, Column]:
    """Half-open chunk range covered by ``[start, stop)`` ms, clamped to the grid; empty for no length."""
    hi = F.least(chunks, F.ceil(stop / F.lit(float(chunk_ms))))
    lo = F.least(F.floor(start / F.lit(float(chunk_ms))), hi)
    hi = F.when(stop <= start, lo).otherwise(hi)
    return F.greatest(lo, F.lit(0)).cast("bigint"), F.greatest(hi, F.lit(0)).cast("bigint")
