"""Canonical JSON, signatures, and order-free identities of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, no blanks and nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def signature(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(**fields), 256)


def list_identity(ids: Column) -> Column:
    """SHA-256 of a sorted id array as a JSON list of strings, for arrays of bounded length."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(F.array_sort(ids), '","'), F.lit('"]')), 256)


def set_digest(key: Column) -> Column:
    """An order-free, combinable identity of a set of keys of any size: the sum of 48 bits of each one's SHA-256."""
    return F.sum(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("decimal(20,0)"))


def inventory_identity(files: DataFrame, place: str = "place") -> DataFrame:
    """One row, ``identity``: the SHA-256 of an ordered inventory (``place``, ``path``, ``size``, ``sha256``).

    Each file's line is hashed and the hashes are folded in the order of their
    places: within ranges of 1,024 places first, then over the ranges.
    """
    line = F.sha2(F.concat_ws("\n", F.col("path"), F.col("size").cast("string"), F.col("sha256")), 256)
    folded = lambda rows, by: F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(by, "h")))["h"], ""), 256).alias("h")
    ranges = files.select(F.col(place).alias("place"), F.floor(F.col(place) / 1024).alias("range"), line.alias("h")).groupBy("range").agg(folded(files, "place"))
    return ranges.agg(folded(ranges, "range").alias("identity"))


def map_signature(files: Column) -> Column:
    """SHA-256 of a map of file name to hash as canonical JSON, whatever the order of its entries."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(files)))), 256)


def buffer_key(identity: Column, rate: Column, kind: Column, shape: Column, content: Column) -> Column:
    """SHA-256 of an audio buffer with all that tells how it is to be read."""
    head = F.concat_ws("\n", identity, rate.cast("string"), kind, shape.cast("string"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), F.encode(F.lit("\n"), "UTF-8"), content), 256)
