"""Events from annotation JSON: tracks, events and segments exploded, faults kept beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.ids import event_id
from turnloom.operators.labels import read_state

SCHEMA = (
    "nTrack int, fs int, timeLenInSec double, asr array<array<struct<startInMs double, endInMs double, LID string, state string,"
    " labels struct<txt string>, speaker struct<segments array<struct<startSec double, endSec double>>>>>>"
)
#: Ends up to this far beyond the recording are clipped; beyond ``NOTED_MS`` that is recorded; starts of segments may be so much before 0.
OVERHANG_MS, NOTED_MS, BEFORE_MS = 160.0, 1.0, 1.0


def clipped_end(end: Column, length: Column, tolerance: float = OVERHANG_MS) -> Column:
    """``end``, set to ``length`` if it is at most ``tolerance`` beyond it; null if it is further out."""
    return F.when(end <= length, end).when(end - length <= tolerance, length)


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # NaN compares as larger


def events_of(sources: DataFrame) -> DataFrame:
    """A row per annotated event of ``sources`` (``source_id``, ``metadata`` as JSON text, ``duration_ms``).

    ``faults`` of an event: ``bounds`` (start or end no finite number: it has no
    more columns than its id, place and faults), ``order`` (a start before the last
    readable one of its track), ``range`` (a start below 0 or beyond the recording,
    an end before the start or more than ``OVERHANG_MS`` beyond the recording),
    ``state`` (unknown), ``segment`` (one unreadable or out of range, where starts
    down to -1 ms are taken as 0). A smaller overhang is clipped, and from
    ``NOTED_MS`` on kept in ``repairs``, of the event with a null
    ``segment_index``. Segments that are left empty or faulty are left out.
    Without segments an event with a valid envelope and text is a fallback
    candidate. Unreadable or null metadata gives no event.
    """
    parsed = sources.select("source_id", "duration_ms", F.from_json(F.col("metadata").cast("string"), SCHEMA).alias("m"))
    tracks = parsed.select("source_id", "duration_ms", F.posexplode("m.asr").alias("channel", "events"))
    rows = tracks.select("source_id", "duration_ms", "channel", F.posexplode("events").alias("ordinal", "e"))
    length, start, end = F.col("duration_ms"), F.col("e.startInMs"), F.col("e.endInMs")
    rows = rows.withColumn("read", _finite(start) & _finite(end))
    # a track was one array of one document, so it is in one task already
    along = Window.partitionBy("source_id", "channel").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous", F.coalesce(F.last(F.when(F.col("read"), start), True).over(along), F.lit(-1.0)))
    inside = (start >= 0) & (end >= start) & (start <= length)
    clipped = F.when(inside, clipped_end(end, length))
    effective = F.coalesce(clipped, end)

    def segment(s: Column, i: Column) -> Column:
        a, b = s["startSec"] * 1000.0, s["endSec"] * 1000.0
        ok = _finite(a) & _finite(b) & (a >= -BEFORE_MS) & (b >= a) & (a <= length)
        stop = F.when(ok, clipped_end(b, length))
        over = F.when(stop < b, b - length)
        repair = F.when(over > NOTED_MS, F.struct(i.alias("segment_index"), b.alias("original_end_ms"), stop.alias("effective_end_ms"), over.alias("overhang_ms")))
        return F.struct(F.greatest(a, F.lit(0.0)).alias("start"), stop.alias("stop"), repair.alias("repair"))

    rows = rows.withColumn("segments", F.coalesce(F.transform("e.speaker.segments", segment), F.array().cast(
        "array<struct<start:double,stop:double,repair:struct<segment_index:int,original_end_ms:double,effective_end_ms:double,overhang_ms:double>>>")))
    state, wrong = read_state(F.col("e.state"))
    faults = F.when(F.col("read"), F.array_compact(F.array(
        F.when(start < F.col("previous"), "order"), F.when(clipped.isNull(), "range"), F.when(wrong, "state"),
        F.when(F.exists("segments", lambda s: s["stop"].isNull()), "segment"),
    ))).otherwise(F.array(F.lit("bounds")))
    kept = F.filter("segments", lambda s: s["stop"] > s["start"])
    pairs = F.transform(kept, lambda s: F.array(s["start"], s["stop"]))
    over = F.when(clipped < end, end - length)
    own = F.when(over > NOTED_MS, F.struct(F.lit(None).cast("int").alias("segment_index"), end.alias("original_end_ms"), clipped.alias("effective_end_ms"), over.alias("overhang_ms")))
    text = F.coalesce("e.labels.txt", F.lit(""))
    good = lambda c: F.when(F.col("read"), c)
    return rows.select(
        event_id(F.col("source_id"), F.col("channel"), F.col("ordinal")).alias("event_id"), "source_id", "channel", "ordinal",
        good(start).alias("start_ms"), good(end).alias("end_ms"), good(effective).alias("effective_end_ms"), good(F.col("e.LID")).alias("lid"), good(text).alias("text"),
        good(F.col("e.state")).alias("official_state_raw"), good(state).alias("official_state"), good(pairs).alias("speaker_segments_ms"),
        good(F.when(F.size(kept) > 0, "speaker_segments").otherwise("none")).alias("activity_source"),
        good(F.array(start, end)).alias("event_envelope_ms"), good(F.array(start, effective)).alias("effective_event_envelope_ms"),
        good(F.array_compact(F.concat(F.array(own), F.transform("segments", lambda s: s["repair"])))).alias("repairs"), faults.alias("faults"),
        good((F.size(kept) == 0) & (start >= 0) & (effective > start) & (effective <= length) & (F.trim(text) != "")).alias("activity_fallback_candidate"),
    )
