"""Label states: reading them, choosing between sources, and checking a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of an event.
EVENT_STATES = ("complete", "incomplete", "backchannel", "wait")


def read_state(raw: Column) -> tuple[Column, Column]:
    """``(state, is_error)``: null and empty are no state; anything but ``<|known|>`` is an error."""
    inner = F.regexp_extract(raw, r"^<\|([a-z]+)\|>$", 1)
    state = F.when(inner.isin(*EVENT_STATES), inner)
    return state, F.coalesce((raw != "") & state.isNull(), F.lit(False))


def latest(rows: DataFrame, key: str, columns: list[str], by: list[str]) -> DataFrame:
    """The columns of each key's last row: a combinable ``max`` of a struct, so hot keys are halved before the shuffle."""
    pick = F.max(F.struct(*by, *[c for c in columns if c not in by])).alias("x")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, *[f"x.{c}" for c in columns])


def precedence(official: Column, substitute: Column) -> tuple[Column, Column]:
    """``(state, origin)``: the official state, ``wait`` read as complete, else the substitute, else null."""
    state = F.when(official == "wait", "complete").when(official.isNotNull(), official).otherwise(substitute)
    origin = F.when(official == "wait", "wait_as_complete").when(official.isNotNull(), "official").when(substitute.isNotNull(), "substitute").otherwise("none")
    return state, origin


def response_faults(asked: Column, given: Column) -> Column:
    """What is wrong with a response (array of structs event_id, state, confidence, reason) to the ids asked for."""
    ids = F.transform(given, lambda x: x["event_id"])
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(asked, ids)) > 0, "unanswered"),
        F.when(F.size(F.array_except(ids, asked)) > 0, "unasked"),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated"),
        F.when(F.exists(given, lambda x: ~F.coalesce(x["state"].isin(*EVENT_STATES), F.lit(False))), "state"),
        F.when(F.exists(given, lambda x: ~F.coalesce(x["confidence"].between(0.0, 1.0), F.lit(False))), "confidence"),
        F.when(F.exists(given, lambda x: ~F.coalesce(F.length(x["reason"]).between(1, 160), F.lit(False))), "reason"),
    ))
