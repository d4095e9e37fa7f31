"""Recognised tokens: checks, the chunk they are emitted in, evidence of activity, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.bounds import CHUNK_MS, chunk_range
from turnloom.operators import grid


def emit_chunk(end_ms: Column, chunks: Column, chunk_ms: int = CHUNK_MS) -> Column:
    """Chunk in which a token's end lies, clamped to the grid."""
    return F.greatest(F.lit(0), F.least(chunks - 1, F.ceil(end_ms / F.lit(float(chunk_ms))) - 1)).cast("int")


def token_faults(tokens: Column, duration_ms: Column) -> Column:
    """Names of what is wrong with a token array: an empty array if nothing is.

    ``untimed``: a bound is missing or no finite number; ``reversed``: end
    before start; ``disorder``: starts or ends go back; ``late``: an end more
    than 1 ms after the recording's; ``control``: a piece of a control token.
    """
    any_ = lambda test: F.exists(tokens, test)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    back = lambda field: F.exists(
        F.zip_with(tokens[field], F.slice(tokens[field], F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: b < a), lambda x: x
    )
    faults = F.array(
        F.when(any_(lambda t: bad(t["start_ms"]) | bad(t["end_ms"])), "untimed"),
        F.when(any_(lambda t: t["end_ms"] < t["start_ms"]), "reversed"),
        F.when(back("start_ms") | back("end_ms"), "disorder"),
        F.when(any_(lambda t: t["end_ms"] > duration_ms + 1), "late"),
        F.when(any_(lambda t: t["token"].contains("<|") | t["token"].contains("|>")), "control"),
    )
    return F.array_compact(faults)


def has_activity(start_ms: Column, end_ms: Column, active: Column, tolerance: int = 2, chunk_ms: int = CHUNK_MS) -> Column:
    """Is any chunk of the track active within ``tolerance`` chunks of the token?"""
    lo, hi = chunk_range(start_ms, end_ms, F.size(active).cast("bigint"), chunk_ms)
    first, last = F.greatest(F.lit(0), lo - tolerance), F.least(F.size(active).cast("bigint"), hi + tolerance)
    return F.exists(F.slice(active, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")), lambda x: x)


def evidence(results: DataFrame, views: DataFrame, envelopes: DataFrame, tolerance: int = 2) -> tuple[DataFrame, DataFrame]:
    """Timed tokens with what they are near: the track's activity, and the envelopes of fallback events.

    ``results``: ``result_id``, ``view_id``, ``tokens``; ``views``: ``view_id``,
    ``chunk_count``, ``target_active_by_chunk``; ``envelopes``: ``view_id``,
    ``event_id``, ``lo``, ``hi`` in chunks. Near is within ``tolerance`` chunks.
    Returns the tokens (``view_id``, ``result_id``, ``place``, ``emit_chunk``,
    ``active``) and the pairs (``view_id``, ``result_id``, ``place``, ``active``,
    ``event_id``).
    A token of no length counts, one without finite times from 0 on doesn't.
    """
    timed = lambda t: (t["end_ms"] >= t["start_ms"]) & (t["start_ms"] >= 0) & (t["end_ms"] < float("inf"))
    size = F.size("target_active_by_chunk").cast("bigint")

    def read(t: Column, i: Column) -> Column:
        lo, hi = chunk_range(t["start_ms"], t["end_ms"], size)
        active = F.coalesce(has_activity(t["start_ms"], t["end_ms"], F.col("target_active_by_chunk"), tolerance), F.lit(False))
        return F.when(timed(t), F.struct(i.alias("place"), lo.alias("lo"), hi.alias("hi"), emit_chunk(t["end_ms"], F.col("chunk_count")).alias("emit_chunk"), active.alias("active")))

    joined = results.select("result_id", "view_id", "tokens").join(views.select("view_id", "chunk_count", "target_active_by_chunk"), "view_id")
    rows = joined.select("view_id", "result_id", F.inline(F.array_compact(F.transform("tokens", read))))
    # half of the tolerance is given to either side, so that ranges of no length can meet
    left = rows.select("view_id", F.struct("result_id", "place", "active").alias("left_id"), (F.col("lo") - tolerance // 2).alias("lo"), (F.col("hi") + tolerance // 2).alias("hi"))
    wide = tolerance - tolerance // 2
    right = envelopes.select("view_id", F.col("event_id").alias("right_id"), (F.col("lo") - wide).alias("lo"), (F.col("hi") + wide).alias("hi"))
    pairs = grid.overlap_pairs(left, right, "view_id").select("view_id", "left_id.*", F.col("right_id").alias("event_id"))
    return rows.drop("lo", "hi"), pairs


def render_groups(tokens: DataFrame, keys: list[str], order: str, token: str) -> DataFrame:
    """Text of each group of tokens: no space but after a token with ASCII letters or digits and no Han.

    A group is the tokens of one chunk, so it is short. Null and empty tokens
    are left out.
    """
    ascii_ = F.col(token).rlike("[A-Za-z0-9]") & ~F.col(token).rlike(r"[\x{4e00}-\x{9fff}]")
    kept = tokens.filter(F.length(token) > 0).select(*keys, order, token, ascii_.alias("ascii"))
    along = Window.partitionBy(*keys).orderBy(order, token)
    piece = F.concat(F.when(F.lag("ascii").over(along), " ").otherwise(""), F.col(token))
    placed = kept.select(*keys, F.struct(F.col(order).alias("o"), F.col(token).alias("t"), piece.alias("p")).alias("x"))
    return placed.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("x"))["p"], "").alias("text"), F.count("*").alias("tokens"))
