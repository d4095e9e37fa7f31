"""Results kept by a content key: hits, misses, and adding only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key).distinct(), key, "left_semi")


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """One row per key that is not in the cache."""
    return wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def with_new(cache: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The cache and those results whose key it lacks: adding the same results again changes nothing."""
    return cache.unionByName(misses(results, cache, key), allowMissingColumns=True)


def call_order(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key its first call (a miss) and how many later ones hit: combinable, no sorting of a key's calls."""
    first = F.min(F.struct(*order)).alias("first")
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), first).select(*keys, (F.col("calls") - 1).alias("hits"), *[F.col(f"first.{c}").alias(f"first_{c}") for c in order])
