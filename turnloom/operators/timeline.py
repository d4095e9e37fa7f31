"""State per chunk of a view: claims of its events, conflicts, and quarantine.

All in long form. What is said of a chunk is grouped by (view, chunk), so a view
with very many events is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event of each state claims for its active chunks, and for the chunk after them.
ACTIVE = {"complete": "user_nonidle", "incomplete": "user_nonidle", "wait": "user_nonidle", "backchannel": "user_backchannel"}
TERMINAL = {"complete": "user_complete", "incomplete": "user_incomplete", "wait": "user_complete"}


def _mapped(state: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in names.items():
        out = F.when(state == key, value).otherwise(out)
    return out


def decision_chunks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per event the chunk after its last active one, and how many are active."""
    return cells.groupBy(*keys).agg((F.max("chunk") + 1).alias("decision_chunk"), F.count("*").alias("active_chunks"))


def claims(cells: DataFrame, states: DataFrame) -> DataFrame:
    """``(view_id, chunk, event_id, kind, state)`` from event cells and ``states`` (event_id, state).

    An event claims its active chunks, and unless it is a backchannel the chunk
    after the last one. Events of no known state claim nothing.
    """
    known = states.select("event_id", "state").withColumn("active", _mapped(F.col("state"), ACTIVE)).withColumn("terminal", _mapped(F.col("state"), TERMINAL)).drop("state")
    stated = cells.select("view_id", "event_id", "chunk").join(known, "event_id").filter("active is not null")
    activity = stated.select("view_id", "chunk", "event_id", F.lit("activity").alias("kind"), F.col("active").alias("state"))
    ends = stated.filter("terminal is not null").groupBy("view_id", "event_id", "terminal").agg((F.max("chunk") + 1).alias("chunk"))
    return activity.unionByName(ends.select("view_id", "chunk", "event_id", F.lit("terminal").alias("kind"), F.col("terminal").alias("state")))


def span_claims(spans: DataFrame) -> DataFrame:
    """As :func:`claims`, from chunk ranges ``view_id``, ``event_id``, ``state``, ``lo``, ``hi`` of events.

    The state goes with the ranges, so no cell is joined, and the chunk after an
    event's last one follows from its ranges' ends. Ranges may repeat and meet; a
    chunk then comes in several equal claims, which change nothing.
    """
    known = spans.filter("lo < hi").withColumn("active", _mapped(F.col("state"), ACTIVE)).withColumn("terminal", _mapped(F.col("state"), TERMINAL)).filter("active is not null")
    chunk = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("chunk")
    activity = known.select("view_id", chunk, "event_id", F.lit("activity").alias("kind"), F.col("active").alias("state"))
    ends = known.filter("terminal is not null").groupBy("view_id", "event_id", "terminal").agg(F.max("hi").alias("chunk"))
    return activity.unionByName(ends.select("view_id", "chunk", "event_id", F.lit("terminal").alias("kind"), F.col("terminal").alias("state")))


def sizes(claimed: DataFrame, grid: DataFrame) -> DataFrame:
    """``(view_id, size)``: chunks of each view's timeline: a chunk more than the view has if a terminal claim needs it."""
    longer = claimed.filter("kind = 'terminal'").groupBy("view_id").agg(F.max("chunk").alias("last"))
    size = F.greatest("chunk_count", F.least(F.coalesce(F.col("last") + 1, F.lit(0)), F.col("chunk_count") + 1))
    return grid.select("view_id", "chunk_count").join(longer, "view_id", "left").filter("chunk_count > 0").select("view_id", size.cast("bigint").alias("size"))


def touched(claimed: DataFrame, lengths: DataFrame, active: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``(view_id, chunk, state, problem, problems)`` of the chunks that anything is said of; all others are idle.

    ``lengths`` as of :func:`sizes`; ``active``: cells of the track's own activity;
    ``forced``: cells to be quarantined anyway, with their ``kind``. One state
    claims a chunk, several leave it null with problem ``conflict``; activity that
    no event covers is ``uncovered``, and wins over a terminal claim. ``problems``
    are all that hold for a chunk, ``problem`` is the first: the forced kinds, then
    ``uncovered``, then ``conflict``.

    All that is said is put together and grouped once: no chunk without claim or
    activity is ever a row.
    """
    text = F.lit(None).cast("string")
    no = F.lit(False)
    said = claimed.select("view_id", "chunk", "state", (F.col("kind") == "activity").alias("covered"), no.alias("active"), text.alias("forced"))
    said = said.unionByName(active.select("view_id", "chunk", text.alias("state"), no.alias("covered"), F.lit(True).alias("active"), text.alias("forced")))
    if forced is not None:
        said = said.unionByName(forced.select("view_id", "chunk", text.alias("state"), no.alias("covered"), no.alias("active"), F.col("kind").alias("forced")))
    cells = said.groupBy("view_id", "chunk").agg(
        F.min("state").alias("least"), F.max("state").alias("most"), F.max("covered").alias("covered"), F.max("active").alias("active"),
        F.array_sort(F.collect_set("forced")).alias("forced"),
    )
    found = F.array_compact(F.array(F.when(F.col("active") & ~F.col("covered"), "uncovered"), F.when(F.col("least") != F.col("most"), "conflict")))
    cells = cells.withColumn("problems", F.concat("forced", found)).join(lengths, "view_id").filter("chunk < size")
    state = F.when(F.size("problems") == 0, F.coalesce("least", F.lit("user_idle")))
    return cells.select("view_id", "chunk", state.alias("state"), F.get("problems", F.lit(0)).alias("problem"), "problems")


def outcomes(cells: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(view_id, outcome, chunks)``: chunks of each state or first problem, the untouched ones being idle."""
    counted = cells.groupBy("view_id", F.coalesce("problem", "state").alias("outcome")).agg(F.count("*").alias("chunks"))
    rest = lengths.join(counted.groupBy("view_id").agg(F.sum("chunks").alias("n")), "view_id", "left")
    idle = rest.select("view_id", F.lit("user_idle").alias("outcome"), (F.col("size") - F.coalesce("n", F.lit(0))).alias("chunks"))
    return counted.unionByName(idle).groupBy("view_id", "outcome").agg(F.sum("chunks").alias("chunks")).filter("chunks > 0")


def resolve(claimed: DataFrame, grid: DataFrame, active: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """State of every chunk of a view: the touched ones as of :func:`touched`, the others idle. ``grid``: ``view_id``, ``chunk_count``."""
    lengths = sizes(claimed, grid)
    return filled(touched(claimed, lengths, active, forced), lengths)


def filled(cells: DataFrame, lengths: DataFrame) -> DataFrame:
    """Touched cells and all others of the views."""
    line = lengths.select("view_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("chunk"))
    # the exploded side is never broadcast: an estimate of its size doesn't know how many rows that makes
    joined = line.join(cells.withColumn("said", F.lit(True)).hint("merge"), ["view_id", "chunk"], "left")
    state = F.when(F.col("said").isNull(), "user_idle").otherwise(F.col("state"))
    return joined.select("view_id", "chunk", state.alias("state"), "problem", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def statuses(events: DataFrame, evidenced: DataFrame, claimed: DataFrame, cells: DataFrame) -> DataFrame:
    """``(event_id, activity_source, status)`` of each event.

    ``events``: ``event_id``, ``spoken`` (has valid segments), ``candidate`` (for
    fallback); ``evidenced``: ``event_id`` of fallback events with a token near. An
    event without activity is ``missing_evidence`` or a ``non_acoustic_placeholder``;
    every event that claims a chunk in conflict has ``state_conflict``, all others
    are ``applied``.
    """
    disputed = cells.filter(F.array_contains("problems", "conflict")).select("view_id", "chunk")
    clashing = claimed.join(disputed, ["view_id", "chunk"], "left_semi").select("event_id").distinct().withColumn("clash", F.lit(True))
    heard = evidenced.select("event_id").distinct().withColumn("heard", F.lit(True))
    rows = events.join(heard, "event_id", "left").join(clashing, "event_id", "left")
    source = F.when(F.col("spoken"), "speaker_segments").when(F.col("candidate"), "event_envelope_fallback").otherwise("none")
    status = F.when(F.col("clash"), "state_conflict").when(F.col("spoken") | (F.col("candidate") & F.col("heard").isNotNull()), "applied")
    return rows.select("event_id", source.alias("activity_source"), status.when(F.col("candidate"), "missing_evidence").otherwise("non_acoustic_placeholder").alias("status"))
