"""Deterministic samples and splits by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut


def hashed_top(rows: DataFrame, group: str, key: str, count: int, offset: int = 0) -> DataFrame:
    """Of each group the rows at places ``offset .. offset + count`` in the order of the key's SHA-256.

    The place filter is pushed into the window, so each task passes on at most
    ``offset + count`` rows of a group, however large that is.
    """
    along = Window.partitionBy(group).orderBy(F.sha2(F.col(key), 256), key)
    placed = rows.drop("place").withColumn("place", F.row_number().over(along)).filter(F.col("place") <= offset + count)
    return placed.filter(F.col("place") > offset)


def hashed_ranks(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with ``place`` (from 1) in the order of a seeded SHA-256, and ``total``.

    Places come from a prefix sum over 4,096 hash ranges and the rank within
    one, so no task sees all keys.
    """
    named = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256))
    named = named.withColumn("r", F.substring("h", 1, 3))
    sizes = named.groupBy("r").agg(F.count("*").alias("n"))
    line = Window.partitionBy(F.lit(0)).orderBy("r")
    sizes = sizes.select("r", (F.sum("n").over(line) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = F.row_number().over(Window.partitionBy("r").orderBy("h", key))
    return named.withColumn("w", within).join(sizes, "r").select(key, (F.col("base") + F.col("w")).alias("place"), "total")


def group_split(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``(key, split)``: the first ``fraction`` of the keys (rounded half to even, 1 .. n - 1) are validation."""
    ranked = hashed_ranks(rows, key, seed)
    held = F.least(F.greatest(F.bround(F.col("total") * F.lit(fraction)).cast("bigint"), F.lit(1)), F.col("total") - 1)
    return ranked.select(key, F.when(F.col("place") <= held, "validation").otherwise("train").alias("split"))


def shared_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split; empty if nothing leaks."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def ordered_places(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Rows with ``place``, from 0, in the order of a text key that is unique.

    Range partitioning puts equal ranges of the key into ``buckets`` parts; places
    are counted within each and the parts' sizes summed up before, so no task sorts
    all rows.
    """
    parts = rows.repartitionByRange(buckets, key).withColumn("_part", F.spark_partition_id())
    # the number of a part depends on sampled borders: written once, so that both uses see the same
    parts = cut(parts)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    placed = parts.withColumn("_inside", inside).join(sizes.select("_part", before.alias("_before")), "_part")
    return placed.withColumn("place", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_part", "_inside", "_before")
