"""Reading one decision out of a trace of states, by four rules, as combinable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The terminal states of a trace and what they mean.
TERMINALS = {"speak": "complete", "wait": "incomplete"}


def read_out(steps: DataFrame, keys: list[str], state: str, at: str, end: str) -> DataFrame:
    """Per trace the ``last``, ``first``, ``closest`` to the end point and first ``after`` it terminal state.

    ``steps``: a row per step with its state, time and the trace's end point.
    Traces needn't be collected or sorted: each rule is a ``min`` or ``max`` of a
    struct. Of equally close ones the earlier wins; a step within 1e-9 before
    the end point counts as at it. A trace without a terminal reads ``none``.
    """
    meant = F.lit(None).cast("string")
    for name, label in TERMINALS.items():
        meant = F.when(F.col(state) == name, label).otherwise(meant)
    t, away = F.col(at).cast("double"), F.abs(F.col(at).cast("double") - F.col(end).cast("double"))
    placed = steps.select(*keys, state, at, end, meant.alias("meant"))

    def pick(order: list[Column], best, cond: Column = F.lit(True)) -> Column:
        row = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)], F.col("meant").alias("m"))
        return F.coalesce(best(F.when(F.col("meant").isNotNull() & cond, row))["m"], F.lit("none"))

    return placed.groupBy(*keys).agg(
        pick([t], F.max).alias("last"), pick([t], F.min).alias("first"), pick([away, t], F.min).alias("closest"),
        pick([t], F.min, t + 1e-9 >= F.col(end).cast("double")).alias("after"),
        F.count(F.when(F.col("meant").isNotNull(), 1)).alias("terminals"),
    )
