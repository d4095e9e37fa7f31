"""Chunk grid: intervals to cells, target against rest, and what a view's arrays say about a range.

Cells are the long form ``(keys, chunk)``. They are made by exploding each
interval's chunk range, so an overlap join becomes an equality on the chunk,
and the work of one recording is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.bounds import CHUNK_MS, chunk_range


def chunk_cells(intervals: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", chunks: str | None = None, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Distinct ``(keys, chunk)`` that the half-open ms intervals touch.

    ``chunks`` names a column with the grid's length, to which ranges are
    clamped; without it they are not. Null bounds, NaN, and intervals of no
    length give no cell; negative starts are clamped to chunk 0.
    """
    end = F.col(chunks) if chunks else F.lit(2**31 - 1)
    lo, hi = chunk_range(F.col(start).cast("double"), F.col(stop).cast("double"), end, chunk_ms)
    ranged = intervals.filter(~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(stop).cast("double")))
    ranged = ranged.select(*keys, lo.alias("lo"), hi.alias("hi")).filter("lo < hi")
    return ranged.select(*keys, F.explode(F.expr("sequence(lo, hi - 1)")).alias("chunk")).distinct()


def target_vs_rest(cells: DataFrame, views: DataFrame) -> DataFrame:
    """Per view the chunks in which its own track, any other, and both are active.

    ``cells``: ``source_id``, ``channel``, ``chunk``; ``views``: ``view_id``,
    ``source_id``, ``channel``. No track is joined to another, and no chunk to a
    view: chunks are counted by the set of tracks active in them, of which a
    recording has few, and a view reads the counts of its recording. A view
    without any active chunk has zeros.
    """
    by_chunk = cells.select("source_id", "channel", "chunk").groupBy("source_id", "chunk").agg(F.array_sort(F.collect_set("channel")).alias("tracks"))
    sets = by_chunk.groupBy("source_id", "tracks").agg(F.count("*").alias("n"))
    own = F.coalesce(F.array_contains("tracks", F.col("channel")), F.lit(False))
    rest = F.coalesce(F.size("tracks") - own.cast("int"), F.lit(0))
    per = views.select("view_id", "source_id", "channel").join(sets, "source_id", "left").select("view_id", own.alias("own"), rest.alias("rest"), F.coalesce("n", F.lit(0)).alias("n"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return per.groupBy("view_id").agg(
        count(F.col("own")).alias("target_chunks"), count(F.col("rest") > 0).alias("rest_chunks"),
        count(F.col("own") & (F.col("rest") > 0)).alias("overlap_chunks"), F.max("rest").alias("most_rest"),
    )


def rest_arrays(tracks: Column, target: Column) -> Column:
    """Array form for one recording: per chunk whether any other track is active, how many, and overlap.

    ``tracks`` is an array of equally long boolean arrays. Null flags count as
    inactive; no tracks give empty arrays.
    """
    length = F.coalesce(F.array_max(F.transform(tracks, F.size)), F.lit(0))
    flag = lambda t, c: F.coalesce(F.get(t, c), F.lit(False)).cast("int")
    chunks = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))

    def at(c: Column) -> Column:
        total = F.aggregate(tracks, F.lit(0), lambda acc, t: acc + flag(t, c))
        own = flag(F.get(tracks, target), c)
        return F.struct((total - own > 0).alias("other"), (total - own).alias("count"), ((own > 0) & (total - own > 0)).alias("overlap"))

    return F.transform(chunks, at)


def true_ranges(flags: Column) -> Column:
    """Half-open ranges ``array<struct<start, stop>>`` of the true elements; null flags are false."""
    def ranges(flags: Column) -> Column:
        size = F.size(flags)
        on = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: on(i) & ((i == 0) | ~on(i - 1)))
        stops = F.filter(places, lambda i: on(i) & ((i == size - 1) | ~on(i + 1)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    # bound to a variable, so that an expression given as flags is evaluated once and not per element
    return F.get(F.transform(F.array(flags), ranges), F.lit(0))


def slice_sums(lo: Column, hi: Column, target: Column, other: Column, overlap: Column, counts: Column) -> list[Column]:
    """Relation of a chunk range to its view: span, active chunks of each kind, most others at once."""
    size = F.greatest(hi - lo, F.lit(0)).cast("int")
    part = lambda a: F.slice(a, (lo + 1).cast("int"), size)
    true = lambda a: F.size(F.filter(part(a), lambda x: x))
    return [
        size.alias("chunk_span"), true(target).alias("target_chunks"), true(other).alias("other_chunks"),
        true(overlap).alias("overlap_chunks"), F.coalesce(F.array_max(part(counts)), F.lit(0)).alias("most_other"),
    ]


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, block: int = 128) -> DataFrame:
    """Pairs of ranges of one key that overlap: ``left_id``, ``right_id``, each once.

    Both sides: ``key``, ``<side>_id``, ``lo``, ``hi`` (half-open). Ranges are
    put into blocks of the axis, so that only near ones meet and a hot key is
    spread over its blocks; a pair is reported in the block where its overlap
    begins. Null or empty ranges meet nothing.
    """
    def placed(rows: DataFrame, side: str) -> DataFrame:
        ok = rows.filter("lo < hi").select(key, f"{side}_id", F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"))
        blocks = F.sequence(F.floor(F.col(f"{side}_lo") / block), F.floor((F.col(f"{side}_hi") - 1) / block))
        return ok.select("*", F.explode(blocks).alias("block"))

    met = placed(left, "left").join(placed(right, "right"), [key, "block"])
    met = met.filter("left_lo < right_hi and right_lo < left_hi")
    first = F.floor(F.greatest("left_lo", "right_lo") / block)
    return met.filter(first == F.col("block")).select(key, "left_id", "right_id")
