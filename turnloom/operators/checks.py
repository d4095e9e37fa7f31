"""Assertions on tables, each a query that returns or counts what violates it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one side only, with ``side``; empty if the key sets are equal. Null keys don't count."""
    a, b = (x.select(key).filter(F.col(key).isNotNull()).distinct() for x in (left, right))
    only = lambda x, y, name: x.join(y, key, "left_anti").withColumn("side", F.lit(name))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def bag_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that the sides hold in different numbers, and ``surplus`` of the left over the right. Nulls are equal."""
    signed = left.select(*columns, F.lit(1).alias("n")).unionByName(right.select(*columns, F.lit(-1).alias("n")))
    return signed.groupBy(*columns).agg(F.sum("n").alias("surplus")).filter("surplus <> 0")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def order_violations(rows: DataFrame, keys: list[str], order: list[str], value: str, span: int = 4096) -> DataFrame:
    """Rows whose value is below that of the row before them in their key, and that ``previous`` value.

    Returns the columns named and ``previous``. The first column of ``order`` is a whole number that cuts a key into spans;
    the row before the first of a span is the last of an earlier one, read from
    a table of one row per span. So a hot key is never sorted in one piece.
    Null values are skipped; equal ones are in order.
    """
    placed = rows.filter(F.col(value).isNotNull()).withColumn("span", F.floor(F.col(order[0]) / span))
    inner = Window.partitionBy(*keys, "span").orderBy(*order, value)
    ends = placed.groupBy(*keys, "span").agg(F.max(F.struct(*order, F.col(value).alias("v"))).alias("end"))
    along = Window.partitionBy(*keys).orderBy("span")
    ends = ends.select(*keys, "span", F.lag("end.v").over(along).alias("carry"))
    before = placed.withColumn("previous", F.lag(value).over(inner)).join(ends, [*keys, "span"])
    before = before.withColumn("previous", F.coalesce("previous", "carry")).drop("carry", "span")
    return before.filter(F.col(value) < F.col("previous"))


def view_faults(views: DataFrame) -> DataFrame:
    """View rows whose arrays break the contract: lengths, counts and overlap against the flags; with ``faults``."""
    names = ("target_active_by_chunk", "other_active_by_chunk", "overlap_by_chunk", "other_active_count_by_chunk")
    sizes = [F.size(n) != F.col("chunk_count") for n in names]
    length = sizes[0] | sizes[1] | sizes[2] | sizes[3]
    target, other, overlap, count = (F.col(n) for n in names)
    any_ = lambda x: F.coalesce(F.exists(x, lambda y: y), F.lit(False))
    faults = F.array_compact(F.array(
        F.when(length, "length"),
        F.when(any_(F.zip_with(other, count, lambda o, n: o != (n > 0))), "count"),
        F.when(any_(F.zip_with(F.zip_with(target, other, lambda t, o: t & o), overlap, lambda a, b: a != b)), "overlap"),
    ))
    return views.withColumn("faults", faults).filter(F.size("faults") > 0)
