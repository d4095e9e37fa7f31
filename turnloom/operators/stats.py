"""Accuracy, paired comparison, bootstrap, and rules on a series of checkpoints."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, keys: list[str], correct: Column) -> DataFrame:
    """Correct, total and share by group; a null outcome is wrong."""
    right = F.count_if(F.coalesce(correct, F.lit(False)))
    return rows.groupBy(*keys).agg(right.alias("correct"), F.count("*").alias("total"), (right / F.count("*")).alias("accuracy"))


def macro(accuracies: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted mean over the classes of each group."""
    return accuracies.groupBy(*keys).agg(F.avg("accuracy").alias("macro_accuracy"), F.count("*").alias("classes"))


def transitions(pairs: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Improved, regressed, unchanged and the difference in percentage points of paired outcomes."""
    return pairs.groupBy(*keys).agg(
        F.count_if(~before & after).alias("improved"), F.count_if(before & ~after).alias("regressed"),
        F.count_if(before == after).alias("unchanged"),
        (F.lit(100.0) * (F.count_if(after) - F.count_if(before)) / F.count("*")).alias("delta_pp"),
    )


def mcnemar(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p-value of a paired comparison; 1 without discordant pairs.

    The binomial tail is summed by its recurrence from the largest term taken
    in logarithms, so large counts don't underflow.
    """
    n = (improved + regressed).cast("double")
    k = F.least(improved, regressed)
    log_factorials = lambda x: F.aggregate(
        F.when(x >= 1, F.sequence(F.lit(1).cast("bigint"), x.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double"))
    )
    peak = log_factorials(n) - log_factorials(k) - log_factorials(n - k) - n * F.lit(0.6931471805599453)
    down = F.sequence(F.lit(0).cast("bigint"), k.cast("bigint"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    # from C(n, k) downwards: C(n, j - 1) = C(n, j) * j / (n - j + 1)
    tail = F.aggregate(
        down, start,
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(peak) * tail))


def bootstrap(deltas: DataFrame, group: str, seed: int = 42, repetitions: int = 10_000) -> DataFrame:
    """95 % interval (in percentage points) of the mean paired difference by group.

    ``deltas``: the group and ``delta`` (-1, 0 or 1). A resample's mean depends
    only on how often each value occurs, so a group goes to its task as three
    counts, whatever its size. Draws are multinomial, so the interval is that of
    another sequence of draws than :func:`evaluation.paired_intervals` repeats.
    """
    counts = deltas.groupBy(group).agg(*[F.count_if(F.col("delta") == d).alias(n) for d, n in ((-1, "down"), (0, "same"), (1, "up"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for name, down, same, up in pdf.itertuples(index=False):
                n = down + same + up
                if not n:
                    continue
                rng = np.random.Generator(np.random.MT19937(random.Random(f"{seed}:{name}").getrandbits(64)))
                draws = rng.multinomial(n, [down / n, same / n, up / n], size=repetitions)
                means = np.sort((draws[:, 2] - draws[:, 0]) / n)
                out.append((name, 100 * means[int(0.025 * repetitions)], 100 * means[int(0.975 * repetitions) - 1]))
            yield pd.DataFrame(out, columns=[group, "low_pp", "high_pp"])

    kind = deltas.schema[group].dataType.simpleString()
    return counts.mapInPandas(run, f"`{group}` {kind}, low_pp double, high_pp double")


def confirmed_declines(series: DataFrame, step: str, value: str, limit: float) -> DataFrame:
    """Steps whose value is below the limit (``trigger``), confirmed if that of the next step is too.

    A series of checkpoints is short: one row each.
    """
    along = Window.partitionBy(F.lit(0)).orderBy(step)
    trigger = series.withColumn("trigger", F.col(value) < limit)
    return trigger.withColumn("confirmed", F.col("trigger") & F.coalesce(F.lead("trigger").over(along), F.lit(False)))


def rewarmed_rate(peak: float, origin: int, step: Column, rewarm: int) -> Column:
    """Learning rate: linear rise over ``rewarm`` steps, then inverse square root from ``origin``."""
    return F.lit(peak) * F.least(F.lit(1.0), step / F.lit(float(rewarm))) * F.sqrt(F.lit(float(origin)) / (F.lit(origin) + step))
