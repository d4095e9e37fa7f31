"""Stages put together: events to views, claims to timelines, timelines to packed sequences.

Rows are nested (one per view, arrays by chunk) only at the ends of a stage; a
recording's arrays are as long as the recording.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import ids
from turnloom.functions.bounds import chunk_range, valid_pair, valid_pairs
from turnloom.operators import grid, packing, timeline, tokens
from turnloom.session import cut


def _nested(cells: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of a key as arrays in the order of ``chunk``."""
    rows = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", *columns))).alias("cells"))
    return rows.select(key, *[F.col(f"cells.{c}").alias(c) for c in columns])


def build_views(sources: DataFrame, events: DataFrame) -> DataFrame:
    """A view per track of each usable recording, with its four arrays.

    ``sources``: ``source_id``, ``ntrack``, ``chunk_count``; ``events``:
    ``source_id``, ``channel``, ``speaker_segments_ms``. Recordings of fewer
    than two tracks or no chunk have no view; events of unknown recordings count
    nowhere.
    """
    tracks = sources.filter("ntrack >= 2 and chunk_count > 0").select("source_id", "ntrack", "chunk_count").dropDuplicates(["source_id"])
    spoken = events.select("source_id", "channel", F.explode(valid_pairs(F.col("speaker_segments_ms"))).alias("x"))
    sized = spoken.select("source_id", "channel", "x.start", "x.stop").join(tracks.select("source_id", "chunk_count"), "source_id")
    active = grid.chunk_cells(sized, ["source_id", "channel"], chunks="chunk_count")
    active = active.groupBy("source_id", "chunk").agg(F.collect_set("channel").alias("on"))
    cells = tracks.select("source_id", "ntrack", F.explode(F.expr("sequence(0L, chunk_count - 1)")).alias("chunk")).join(active.hint("merge"), ["source_id", "chunk"], "left")
    cells = cells.withColumn("on", F.coalesce("on", F.array().cast("array<int>"))).select("source_id", "chunk", "on", F.explode(F.expr("sequence(0, ntrack - 1)")).alias("channel"))
    own = F.array_contains("on", F.col("channel"))
    rest = F.size("on") - own.cast("int")
    flags = cells.select(
        ids.view_id(F.col("source_id"), F.col("channel")).alias("view_id"), "chunk", own.alias("target_active_by_chunk"),
        (rest > 0).alias("other_active_by_chunk"), rest.alias("other_active_count_by_chunk"), (own & (rest > 0)).alias("overlap_by_chunk"),
    )
    names = ["target_active_by_chunk", "other_active_by_chunk", "other_active_count_by_chunk", "overlap_by_chunk"]
    return _nested(flags, "view_id", names).withColumn("chunk_count", F.size(names[0]).cast("bigint"))


def fallback_envelopes(views: DataFrame, events: DataFrame) -> DataFrame:
    """``(view_id, event_id, lo, hi)``: chunks of the envelope of each fallback event, clamped to its view.

    Such an event has no valid speaker segment, is marked as a candidate and has
    a valid envelope.
    """
    view = ids.view_id(F.col("source_id"), F.col("channel")).alias("view_id")
    bare = events.filter(F.col("activity_fallback_candidate") & (F.size(valid_pairs(F.col("speaker_segments_ms"))) == 0))
    spans = bare.select(view, "event_id", valid_pair(F.col("effective_event_envelope_ms")).alias("x")).filter("x is not null").distinct()
    lo, hi = chunk_range(F.col("x.start").cast("double"), F.col("x.stop").cast("double"), F.col("chunk_count"))
    return spans.join(views.select("view_id", "chunk_count"), "view_id").select("view_id", "event_id", lo.alias("lo"), hi.alias("hi"))


@dataclass
class Resolved:
    """What :func:`resolved` finds: touched chunks, lengths, claims, and fallback events with a token near."""

    cells: DataFrame
    lengths: DataFrame
    claimed: DataFrame
    evidenced: DataFrame


def resolved(views: DataFrame, events: DataFrame, results: DataFrame | None = None) -> Resolved:
    """The timelines of all views, from annotated events and recognition results.

    ``views``: ``view_id``, ``chunk_count``, ``target_active_by_chunk``; ``events``:
    ``event_id``, ``source_id``, ``channel``, ``final_state``, ``speaker_segments_ms``,
    ``activity_fallback_candidate``, ``effective_event_envelope_ms``; ``results``:
    ``result_id``, ``view_id``, ``tokens``. Segments are clamped to the view. The
    envelope of a fallback event claims its chunks if a token is near, and is
    quarantined (``fallback``) if none is; so is the chunk of each token that is
    near neither activity nor such an envelope (``outside``). Without ``results``
    the annotation alone is judged, and events need no columns of fallback.
    """
    view = ids.view_id(F.col("source_id"), F.col("channel")).alias("view_id")
    state = F.col("final_state").alias("state")
    spoken = events.select(view, "event_id", state, F.explode(valid_pairs(F.col("speaker_segments_ms"))).alias("x")).join(views.select("view_id", "chunk_count"), "view_id")
    lo, hi = chunk_range(F.col("x.start").cast("double"), F.col("x.stop").cast("double"), F.col("chunk_count"))
    spans = spoken.select("view_id", "event_id", "state", lo.alias("lo"), hi.alias("hi"))
    forced, proven = None, events.select("event_id").limit(0)
    if results is not None:
        # both are small and read several times over
        envelopes = cut(fallback_envelopes(views, events))
        heard, pairs = tokens.evidence(results, views, envelopes)
        pairs = cut(pairs)
        proven = pairs.select("event_id").distinct()
        states = events.select("event_id", state).join(proven, "event_id", "left_semi").distinct()
        spans = spans.unionByName(envelopes.join(states, "event_id").select("view_id", "event_id", "state", "lo", "hi"))
        outside = heard.filter("not active").join(pairs, ["result_id", "place"], "left_anti")
        unproven = envelopes.join(proven, "event_id", "left_anti").filter("lo < hi")
        forced = unproven.select("view_id", F.explode(F.expr("sequence(lo, hi - 1)")).alias("chunk"), F.lit("fallback").alias("kind")).unionByName(
            outside.select("view_id", F.col("emit_chunk").cast("bigint").alias("chunk"), F.lit("outside").alias("kind")))
    claimed = timeline.span_claims(spans)
    active = views.select("view_id", F.posexplode("target_active_by_chunk").alias("chunk", "on")).filter("on").select("view_id", F.col("chunk").cast("bigint").alias("chunk"))
    lengths = timeline.sizes(claimed, views)
    return Resolved(timeline.touched(claimed, lengths, active, forced), lengths, claimed, proven)


def build_timelines(views: DataFrame, events: DataFrame, results: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """States by chunk of each view, and the quarantined ranges of all four kinds; see :func:`resolved`.

    A chunk is in the ranges of every kind that holds.
    """
    found = resolved(views, events, results)
    lines = _nested(timeline.filled(found.cells, found.lengths), "view_id", ["state"]).toDF("view_id", "chunk_states")
    lines = lines.withColumn("effective_chunk_count", F.size("chunk_states").cast("bigint"))
    lost = found.cells.select("view_id", F.explode("problems").alias("kind"), F.col("chunk").cast("int").alias("chunk"))
    lost = lost.groupBy("view_id", "kind").agg(F.array_sort(F.collect_list("chunk")).alias("at"))
    starts = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) != x - 1, F.lit(True)))
    stops = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    ranges = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))
    return lines, lost.select("view_id", "kind", F.inline(ranges)).toDF("view_id", "kind", "start_chunk", "stop_chunk")


def window_events(windows: DataFrame, lines: DataFrame) -> DataFrame:
    """``(window_index, event_ids)``: the sorted events of each window that has any.

    ``windows``: ``view_id``, ``window_index``, ``lo``, ``hi``; ``lines``:
    ``view_id``, ``event_assignments``. An event belongs to a window if one of its
    activity ranges overlaps it or its decision chunk is inside.
    """
    given = lines.select("view_id", F.explode("event_assignments").alias("e")).filter("e.event_id is not null")
    decision = F.array("e.decision_chunk", F.col("e.decision_chunk") + 1)
    ranges = F.concat(F.coalesce("e.activity_chunk_ranges", F.array().cast("array<array<int>>")), F.array(decision))
    ranges = given.select("view_id", F.col("e.event_id").alias("right_id"), F.explode(ranges).alias("r"))
    right = ranges.select("view_id", "right_id", F.get("r", F.lit(0)).alias("lo"), F.get("r", F.lit(1)).alias("hi"))
    met = grid.overlap_pairs(windows.withColumnRenamed("window_index", "left_id"), right, "view_id")
    return met.groupBy(F.col("left_id").alias("window_index")).agg(F.array_sort(F.collect_set("right_id")).alias("event_ids"))


def chunk_groups(states: Column, texts: Column, audio: Column) -> Column:
    """Group text of each chunk; null where the state is, or a part is not allowed."""
    parts = F.arrays_zip(states.alias("s"), texts.alias("t"), audio.alias("a"))
    return F.transform(parts, lambda x: packing.group_text(F.get(x["a"], F.lit(0)), F.get(x["a"], F.lit(1)), F.coalesce(x["t"], F.lit("")), x["s"]))


def _costed(lines: DataFrame, measure: Callable[[Column], Column] | None) -> DataFrame:
    """Lines with ``groups``, and ``costs``: the length of each, null where there is none."""
    measure = measure or (lambda g: F.length(F.regexp_replace(g, r"<\|[^<|>]+\|>", "x")))
    grouped = lines.withColumn("groups", chunk_groups(F.col("chunk_states"), F.col("chunk_texts"), F.col("chunk_audio")))
    return grouped.withColumn("costs", F.transform("groups", lambda g: F.when(g.isNotNull(), measure(g))))


def oversized_chunks(lines: DataFrame, budget: int = 1_500, measure: Callable[[Column], Column] | None = None, prefix_cost: int = 2) -> DataFrame:
    """``(view_id, chunk, cost)`` of the chunks that :func:`export_sequences` leaves out as over the budget alone.

    ``cost`` is that of the group and the prefix. Chunks without a group aren't among them.
    """
    costed = _costed(lines, measure).select("view_id", "costs", F.explode(packing.oversized(F.col("costs"), budget, prefix_cost)).alias("chunk"))
    return costed.select("view_id", "chunk", (F.get("costs", F.col("chunk")) + prefix_cost).alias("cost"))


def export_sequences(lines: DataFrame, budget: int = 1_500, measure: Callable[[Column], Column] | None = None, prefix_cost: int = 2, set_name: str = "set") -> DataFrame:
    """Packed windows of each view with their sequence and metadata.

    ``lines``: ``view_id``, ``source_id``, ``channel``, ``chunk_states``,
    ``chunk_texts``, ``chunk_audio`` (two tokens a chunk), ``other_active_by_chunk``,
    ``overlap_by_chunk``. A chunk without a group ends a window and is left out,
    as is one over the budget alone (:func:`oversized_chunks`). ``measure`` gives a
    group's length, by default the number of control tokens plus other characters.
    Lines with ``event_assignments`` give each window its ``event_ids``.
    """
    grouped = _costed(lines, measure)
    cost = F.transform("costs", lambda c: F.coalesce(c, F.lit(budget + 1)))
    keep = ["view_id", "source_id", "channel", "groups", "other_active_by_chunk", "overlap_by_chunk"]
    windows = grouped.select(*keep, F.inline(packing.greedy_windows(cost, budget, prefix_cost)))
    lo, size = F.col("start"), F.col("stop") - F.col("start")
    part = lambda c: F.slice(F.col(c), lo + 1, size)
    true = lambda c: F.size(F.filter(part(c), lambda x: x))
    made = windows.select(
        ids.window_index(set_name, F.col("source_id"), F.col("channel"), F.col("start"), F.col("stop")).alias("window_index"), "view_id", "source_id",
        F.array("start", "stop").alias("chunk_range"), size.alias("chunk_count"), F.col("cost").cast("int").alias("tokenized_length"),
        true("other_active_by_chunk").alias("other_active_chunk_count"), true("overlap_by_chunk").alias("overlap_chunk_count"),
        F.concat(F.lit(packing.PREFIX), F.array_join(part("groups"), "")).alias("sequence"),
    )
    if "event_assignments" not in lines.columns:
        return made
    spans = made.select("view_id", "window_index", F.get("chunk_range", F.lit(0)).alias("lo"), F.get("chunk_range", F.lit(1)).alias("hi"))
    found = window_events(spans, lines.select("view_id", "event_assignments"))
    none = F.array().cast("array<string>")
    return made.join(found, "window_index", "left").withColumn("event_ids", F.coalesce("event_ids", none))
