"""Pairing each point in time with the nearest interval of the same entity, by expanding rings.

A ring has a radius, and buckets sixteen radii wide. An interval is put into
every bucket that it comes within the radius of, a point into its own one;
points and intervals of one (entity, bucket) are joined. What is nearer than
the radius is surely among these, so the nearest one found is accepted if it
lies within the radius. Points without one go to the next ring, of twice the
radius and twice as wide buckets, until the radius reaches the tolerance.

Within a bucket only the part of an interval inside the bucket's reach can
tell. Intervals are clipped to it, and of those with equal clipped bounds only
the one that wins a tie is kept, which a combinable ``min`` does before the
shuffle: however many intervals cover a bucket, one of them stays. A bucket is
a short time of one entity, so an entity that holds a third of all rows is
spread over as many tasks as its time has buckets.

An interval longer than ``SPREAD`` buckets goes to a coarser level of buckets,
each level ``SPREAD`` times as wide as the one below, so that it lies in few of
them whatever its length. Points look into as many levels as the longest
interval needs, which is one number asked for beforehand; most data need one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import cut

#: Bucket width in radii of the ring, and buckets that an interval may lie in before it goes to the next level.
WIDE = 16
SPREAD = 64
#: Bucket numbers end here: all that lies further out shares the last bucket of its side.
FARTHEST = 2.0**62
#: Up to here bounds of buckets are exact in a DOUBLE and intervals are clipped to them.
CLIPPED = 2.0**50


def _bucket(x: Column, width: float) -> Column:
    return F.floor(F.least(F.greatest(x / F.lit(width), F.lit(-FARTHEST)), F.lit(FARTHEST)))


def _reach(intervals: DataFrame, level: int, width: float, radius: float) -> DataFrame:
    """``(entity, level, bucket, lo, hi, prize)`` of intervals put into the buckets that they come within the radius of."""
    r = F.lit(radius)
    spread = F.sequence(_bucket(F.col("start") - r, width), _bucket(F.col("stop") + r, width))
    rows = intervals.select("*", F.explode(spread).alias("bucket"))
    low = F.col("bucket") * F.lit(width) - r
    near = F.abs(low) < CLIPPED
    # one step outside the reach stands for all that lies beyond
    rows = rows.select(
        "entity", F.lit(level).alias("level"), "bucket",
        F.when(near, F.greatest("start", low - 1)).otherwise(F.col("start")).alias("lo"),
        F.when(near, F.least(F.col("stop"), low + width + 2 * r + 1)).otherwise(F.col("stop")).alias("hi"),
        F.struct(F.col("start"), F.col("item")).alias("prize"),
    )
    return rows.groupBy("entity", "level", "bucket", "lo", "hi").agg(F.min("prize").alias("prize"))


def _ring(points: DataFrame, intervals: DataFrame, radius: float, longest: float) -> DataFrame:
    """Points with ``best``, the nearest interval if it is within the radius."""
    widths = [radius * WIDE]
    while longest > widths[-1] * SPREAD:
        widths.append(widths[-1] * SPREAD)
    length, parts = F.col("stop") - F.col("start"), []
    for level, width in enumerate(widths):
        of_level = F.lit(True)
        if level:
            of_level &= length > width
        if level < len(widths) - 1:
            of_level &= length <= width * SPREAD
        parts.append(_reach(intervals.filter(of_level), level, width, radius))
    reach = reduce(DataFrame.unionByName, parts)
    if len(widths) == 1:
        placed = points.withColumn("bucket", _bucket(F.col("at"), widths[0]))
        reach, where = reach.drop("level"), ["entity", "bucket"]
    else:
        where = ["entity", "level", "bucket"]
        spots = F.array(*[F.struct(F.lit(i).alias("level"), _bucket(F.col("at"), w).alias("bucket")) for i, w in enumerate(widths)])
        placed = points.select("*", F.inline(spots))
    r = F.lit(radius)
    away = F.greatest(F.col("lo") - F.col("at"), F.col("at") - F.col("hi"), F.lit(0.0))
    near = F.when((away <= r) & F.col("prize").isNotNull(), F.struct(away.alias("away"), F.col("prize")))
    # never broadcast: the estimate of an exploded side's size doesn't know how many rows that makes
    paired = placed.join(reach.hint("merge"), where, "left").select(*where, "point", "at", near.alias("near"))
    # with one level a point has one bucket, and its rows are in one place already
    by = [*where, "point", "at"] if len(widths) == 1 else ["entity", "point", "at"]
    return paired.groupBy(*by).agg(F.min("near").alias("best")).select("entity", "point", "at", "best")


def nearest_intervals(points: DataFrame, intervals: DataFrame, tolerance: float, rings: int = 3) -> DataFrame:
    """For each point the interval of its entity that is nearest, at most ``tolerance`` away.

    ``points``: ``entity``, ``point`` (what names it) and ``at``; ``intervals``:
    ``entity``, ``item``, ``start``, ``stop``, closed for the distance: it is 0
    within the bounds, else that to the nearer bound. Of equally near ones the
    smaller start wins, then the smaller item. Returns distinct ``entity``,
    ``point``, ``at``, ``item``, ``away``. Intervals may have any length.

    Rows with a null, NaN or infinite time, a null entity or item, or
    ``stop < start`` don't count; a null point name is kept. Points without an
    interval in reach give no row, nor does an empty table on either side.
    Repeated rows give one result. Other columns are ignored.
    """
    def finite(c: str) -> Column:
        return F.abs(F.col(c)) < float("inf")  # NaN compares as larger

    points = points.select("entity", "point", F.col("at").cast("double").alias("at")).filter(F.col("entity").isNotNull() & finite("at"))
    intervals = intervals.select("entity", "item", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    intervals = intervals.filter("entity is not null and item is not null and stop >= start").filter(finite("start") & finite("stop"))
    intervals = cut(intervals)  # read for their greatest length and by each ring
    longest = intervals.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 0.0
    longest = longest if math.isfinite(longest) else 2.0**1023
    radii = [tolerance / 2**k for k in reversed(range(rings))]
    done, left = [], points
    for radius in radii:
        # it feeds the result and the next ring: both read the same exchanges, which are planned once
        seen = _ring(left, intervals, radius, min(longest, 2 * FARTHEST * radius * WIDE))
        done.append(seen.filter("best is not null").select("entity", "point", "at", F.col("best.prize.item").alias("item"), F.col("best.away").alias("away")))
        left = seen.filter("best is null").drop("best")
    return reduce(DataFrame.unionByName, done)
