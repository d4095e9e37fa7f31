"""Contracts of tokens, traces, selections and label requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens a chunk, size of the audio vocabulary, states of a trace and seconds of its step.
PER_CHUNK, AUDIO_TOKENS, STEP = 2, 51_866, 0.16
TRACE_STATES = ("speak", "wait", "backchannel", "idle", "nonidle", "unknown")


def chunk_tokens(tokens: Column, chunks: Column) -> Column:
    """A flat token array in pairs, one per chunk; null unless it is exactly two per chunk, each in the vocabulary."""
    good = (F.size(tokens) == chunks * PER_CHUNK) & F.forall(tokens, lambda t: F.coalesce(t.between(0, AUDIO_TOKENS - 1), F.lit(False)))
    pairs = F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.slice(tokens, i * PER_CHUNK + 1, F.lit(PER_CHUNK)))).otherwise(F.array().cast("array<array<int>>"))
    return F.when(good, pairs)


def sequence_groups(token_ids: Column, prefix: list[int], audio: tuple[int, int], end: int, states: list[int]) -> Column:
    """``struct<groups, texts>`` of a token id array that follows the grammar, else null.

    A fold over the ids whose state is what may come next: 0 and 1 a first and
    second audio token, 2 text or the end, 3 a state; -1 is a fault.
    """
    is_audio = lambda t: t.between(*audio)
    body = F.slice(token_ids, F.lit(len(prefix) + 1), F.greatest(F.size(token_ids) - len(prefix), F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("groups"), F.lit(0).alias("texts"))

    def step(acc: Column, t: Column) -> Column:
        nxt = (
            F.when((acc["at"] == 0) & is_audio(t), 1).when((acc["at"] == 1) & is_audio(t), 2).when((acc["at"] == 2) & (t == end), 3)
            .when((acc["at"] == 2) & ~is_audio(t) & ~t.isin(*states) & ~t.isin(*prefix), 2).when((acc["at"] == 3) & t.isin(*states), 0).otherwise(-1)
        )
        text = ((acc["at"] == 2) & (t != end)).cast("int")
        return F.struct(nxt.alias("at"), (acc["groups"] + (acc["at"] == 3).cast("int")).alias("groups"), (acc["texts"] + text).alias("texts"))

    read = F.aggregate(body, start, step)
    begins = F.slice(token_ids, 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix])
    return F.when(begins & (read["at"] == 0) & (read["groups"] > 0), F.struct(read["groups"].alias("groups"), read["texts"].alias("texts")))


def trace_faults(trace: Column) -> Column:
    """What is wrong with a trace (array of ``state``, ``timestamp`` of two): empty, an unknown state, a step off its time."""
    near = lambda x, k: F.get(x["timestamp"], F.lit(k))
    wrong = lambda x, i: F.greatest(F.abs(near(x, 0) - i * F.lit(STEP)), F.abs(near(x, 1) - (i + 1) * F.lit(STEP))) > 1e-8
    whole = lambda x: F.size(F.array_compact(x["timestamp"])) == 2
    off = F.exists(F.transform(trace, lambda x, i: ~F.coalesce(whole(x), F.lit(False)) | wrong(x, i)), lambda b: F.coalesce(b, F.lit(True)))
    unknown = F.exists(trace, lambda x: ~F.coalesce(x["state"].isin(*TRACE_STATES), F.lit(False)))
    return F.array_compact(F.array(F.when(F.coalesce(F.size(trace), F.lit(0)) < 1, "empty"), F.when(unknown, "state"), F.when(off, "time")))


def selected(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted keys, and the wanted keys that are repeated or unknown, with ``fault``."""
    counted = wanted.groupBy(key).agg(F.count("*").alias("asked"))
    known = rows.select(key).distinct().withColumn("known", F.lit(True))
    fault = F.when(F.col("asked") > 1, "repeated").when(F.col("known").isNull(), "unknown")
    bad = counted.join(known, key, "left").select(key, fault.alias("fault")).filter("fault is not null")
    return rows.join(counted.select(key), key, "left_semi"), bad


def label_context(official: Column, requested: Column) -> Column:
    """How an event stands in a label request: its own state, asked for, or neither."""
    return F.when(requested, "TO_LABEL").when(official.isNull(), "UNLABELED_NOT_REQUESTED").otherwise(official)


def stable_and_declining(rows: DataFrame, keys: list[str], macro_delta: str, class_delta: str) -> DataFrame:
    """Per key whether all deltas (in points) are above the floors, and whether any is below the limits.

    Floors -1 for language means and -2 for classes; limits -3 and -5.
    """
    return rows.groupBy(*keys).agg(
        F.bool_and((F.col(macro_delta) >= -1) & (F.col(class_delta) >= -2)).alias("almost_unchanged"),
        F.bool_or((F.col(macro_delta) < -3) | (F.col(class_delta) < -5)).alias("decline"),
    )


def best_step(rows: DataFrame, keys: list[str], value: str, step: str) -> DataFrame:
    """Step of the largest value per key, the smaller of equals."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s"))).alias("x")
    return rows.groupBy(*keys).agg(top).select(*keys, (-F.col("x.s")).alias("best_step"), F.col("x.v").alias("best_value"))
