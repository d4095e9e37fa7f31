"""Chunk groups, their packing into windows under a budget, and the sequence grammar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefix of every sequence, and the states that end a group.
PREFIX = "<|task_duplex_predict|><|punctuation_off|>"
STATES = ("user_idle", "user_nonidle", "user_complete", "user_incomplete", "user_backchannel")


def group_text(first: Column, second: Column, text: Column, state: Column) -> Column:
    """``<|audio_a|><|audio_b|>text<|end_of_sentence|><|state|>``; null where a part is missing or not allowed.

    Audio tokens are from 0, below 51,866; the text holds no piece of a control
    token; the state is one of the five.
    """
    good = first.between(0, 51_865) & second.between(0, 51_865) & state.isin(*STATES) & ~text.contains("<|") & ~text.contains("|>")
    return F.when(good, F.format_string("<|audio_%d|><|audio_%d|>%s<|end_of_sentence|><|%s|>", first, second, text, state))


def is_sequence(sequence: Column) -> Column:
    """Does the whole text follow the grammar: prefix, then groups of two audio tokens, text, end, state?"""
    prefix = PREFIX.replace("|", r"\|")
    return sequence.rlike(rf"^{prefix}(?:<\|audio_\d+\|><\|audio_\d+\|>[^<|>]*+<\|end_of_sentence\|><\|(?:{'|'.join(STATES)})\|>)++$")


def state_tokens(sequence: Column) -> Column:
    """States that end the groups of a sequence, in order."""
    return F.regexp_extract_all(sequence, F.lit(rf"<\|({'|'.join(STATES)})\|>"), F.lit(1))


def greedy_windows(costs: Column, budget: Column | int, prefix: int = 0) -> Column:
    """Packing an ordered array of costs: ``array<struct<start, stop, cost>>``, half-open places.

    A window takes items while ``prefix`` and their costs are within the
    budget. An item that is over the budget alone is left out and ends the
    window before it. One fold over the row's own array, whose state is where
    the open window starts, its cost, and the windows closed so far. Null costs
    count as 0; an empty or null array has no window.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    none = F.array().cast("array<struct<start:int,stop:int,cost:double>>")
    place = F.transform(costs, lambda c, i: F.struct(i.alias("i"), F.coalesce(c, F.lit(0)).cast("double").alias("c")))

    def window(acc: Column, stop: Column) -> Column:
        made = F.struct(acc["start"].alias("start"), stop.alias("stop"), acc["cost"].alias("cost"))
        return F.when(stop > acc["start"], F.concat(acc["done"], F.array(made))).otherwise(acc["done"])

    def state(start: Column, cost: Column, done: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), cost.cast("double").alias("cost"), done.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        alone, fits = F.lit(prefix) + x["c"], acc["cost"] + x["c"] <= limit
        closed = window(acc, x["i"])
        return (
            F.when(alone > limit, state(x["i"] + 1, F.lit(prefix), closed))
            .when(fits | (x["i"] <= acc["start"]), state(acc["start"], acc["cost"] + x["c"], acc["done"]))
            .otherwise(state(x["i"], alone, closed))
        )

    start = state(F.lit(0), F.lit(prefix), none)
    return F.aggregate(place, start, step, lambda acc: window(acc, F.size(costs)))


def oversized(costs: Column, budget: int, prefix: int = 0) -> Column:
    """Places of the items that are over the budget alone."""
    place = F.transform(costs, lambda c, i: F.when(F.lit(prefix) + c > budget, i))
    return F.array_compact(place)
