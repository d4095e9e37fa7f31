"""Merging overlapping intervals into continuous periods, and the gaps between those.

How it holds at scale. A key (view, channel, object) may own a third of all
rows, so no step puts a whole key into one task, and an interval of any length
is one row: it lies in the block of the axis in which it *starts* and is never
cut into pieces. Per (key, block) only one row per start survives a combinable
``max(stop)``. Spark's ``session_window`` with each row's own duration then
merges what overlaps within a block. What reaches into a block from earlier ones
is a running ``max(stop)`` over the blocks before it, worked out in two levels:
blocks within a wide block, wide blocks within the key. A session that begins
beyond all that was reached so far opens a period and closes a gap; touching
ones don't, which the sessions themselves leave apart.

The axis has 2**64 units, a block 2**20 and a wide block 2**42: at most 2**22
rows of a key are ever sorted together, whatever the input. The sessions, and
then the periods' starts, are written once to the shared folder, as each feeds
several branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut

#: Axis units per block, and blocks per wide block; powers of two.
BLOCK = 2**20
WIDE = 2**22


def _sessions(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """One row per session of a (key, block); one axis unit is a second of the session window."""
    bits = block.bit_length() - 1
    starts = rows.groupBy(*keys, F.shiftright("start", bits).alias("block"), "start").agg(F.max("stop").alias("stop"))
    low = F.shiftleft("block", bits)
    inside = F.least(F.col("stop") - 1, low + (block - 1)) - F.col("start") + 1
    placed = starts.select(*keys, "block", "start", "stop", F.timestamp_seconds(F.col("start") - low).alias("at"), inside.cast("decimal(18,6)").alias("inside"))
    lasting = F.expr("make_interval(0, 0, 0, 0, 0, 0, inside)")
    window = F.session_window("at", lasting)
    merged = placed.groupBy(*keys, "block", window).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.drop("session_window")


def _carried(blocks: DataFrame, keys: list[str], wide: int) -> DataFrame:
    """``(keys, block, carry)``: the greatest ``v`` of the earlier blocks of the key, for one row per (key, block)."""
    blocks = blocks.withColumn("wide", F.shiftright("block", wide.bit_length() - 1))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.select(*keys, "wide", "block", F.max("v").over(earlier([*keys, "wide"], "block")).alias("near"))
    far = blocks.groupBy(*keys, "wide").agg(F.max("v").alias("v"))
    far = far.select(*keys, "wide", F.max("v").over(earlier(keys, "wide")).alias("far"))
    return near.join(far, [*keys, "wide"]).select(*keys, "block", F.greatest("near", "far").alias("carry"))


def periods_and_gaps(intervals: DataFrame, keys: list[str], block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Continuous periods of each key's intervals, and the gaps between neighbouring periods.

    ``intervals`` has the key columns and BIGINT ``start`` and ``stop``
    (half-open, any values); other columns are ignored. Returns the keys,
    ``kind`` (``period`` or ``gap``), ``start_at`` and ``stop_at``, each row once.

    Overlapping, nested, repeated and touching intervals belong together,
    however long they are. Rows with a null key, a null bound or ``stop <=
    start`` don't count. A key without valid intervals gives no row, one with a
    single period no gap; an empty table gives an empty result.
    """
    if block & (block - 1) or wide & (wide - 1) or min(block, wide) < 2:
        raise ValueError("block and wide are powers of two")
    ks = [f"k{i}" for i in range(len(keys))]
    good = F.col("stop") > F.col("start")
    for key in keys:
        good &= F.col(key).isNotNull()
    rows = intervals.filter(good).select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))
    along, whole = Window.partitionBy(*ks, "block").orderBy("start"), Window.partitionBy(*ks, "block")
    first = F.lag("start").over(along).isNull().alias("first")
    so_far = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("so_far")
    sessions = cut(_sessions(rows, ks, block).select(*ks, "block", "start", "stop", so_far, first, F.max("stop").over(whole).alias("top")))

    carried = _carried(sessions.filter("first").select(*ks, "block", F.col("top").alias("v")), ks, wide)
    reached = sessions.join(carried, [*ks, "block"]).select(*ks, "block", "start", F.greatest("so_far", "carry").alias("reach"))
    opens = reached.filter("reach is null or start > reach")
    opens = cut(opens.select(
        *ks, "block", "start", "reach", first, F.max("start").over(whole).alias("top"),
        F.lead("start").over(along).alias("next"), F.lead("reach").over(along).alias("end"),
    ))

    def pair(of: DataFrame, start: str, stop: str, after: str) -> DataFrame:
        """A period, and the gap up to the start of the next one."""
        row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_at"), F.col(b).alias("stop_at"))
        return of.select(*ks, F.inline(F.array(row("period", start, stop), row("gap", stop, after))))

    heads = opens.filter("first")
    since = _carried(heads.select(*ks, "block", F.col("top").alias("v")), ks, wide)
    across = heads.filter("reach is not null").select(*ks, "block", "reach", "start").join(since, [*ks, "block"])
    # the last period of a key has no gap after it
    none = F.lit(None).cast("bigint")
    last = heads.select(*ks, F.col("top").alias("start"), none.alias("stop")).unionByName(sessions.filter("first").select(*ks, none.alias("start"), F.col("top").alias("stop")))
    last = last.groupBy(*ks).agg(F.lit("period").alias("kind"), F.max("start").alias("start_at"), F.max("stop").alias("stop_at"))
    found = pair(opens.filter("next is not null"), "start", "end", "next").unionByName(pair(across, "carry", "reach", "start")).unionByName(last)
    return found.toDF(*keys, "kind", "start_at", "stop_at")


def merge_intervals(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Only the periods of :func:`periods_and_gaps`."""
    return periods_and_gaps(intervals, keys, block).filter("kind = 'period'").drop("kind")


def interval_gaps(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Only the gaps of :func:`periods_and_gaps`."""
    return periods_and_gaps(intervals, keys, block).filter("kind = 'gap'").drop("kind")
