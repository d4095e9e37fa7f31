"""Comparing checkpoints with a baseline: classes, languages, resampling, gates, and the choice of a learning rate.

Outcomes are counted first, so what the rules work on is one row per class and
checkpoint. Only the resampling that must repeat a given generator's draws needs
the single outcomes of a class in order; it is for test sets, of which a class is
one array of small integers. For larger groups :func:`stats.bootstrap` draws from
counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators import stats

#: Floors of an unchanged checkpoint and limits of a decline in points (language mean, class), tolerance of the gate.
FLOORS, LIMITS, GATE = (-1.0, -2.0), (-3.0, -5.0), 1.0
#: Largest drop of a head's accuracy that is safe, and relative gap of objectives within which the lower rate wins.
SAFE_DROP, TIE = 0.05, 0.01


class Draws:
    """The whole numbers below a bound that ``random.Random(seed).randrange`` gives, many at once."""

    def __init__(self, seed: int):
        state = random.Random(seed).getstate()[1]
        self.source = np.random.RandomState()
        self.source.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
        self.ahead = np.empty(0, np.uint32)

    def below(self, bound: int, count: int) -> np.ndarray:
        """The next ``count`` draws: the top bits of each 32-bit output, outputs that are not below the bound skipped."""
        bits = bound.bit_length()
        out = np.empty(0, np.int64)
        while len(out) < count:
            if not len(self.ahead):
                self.ahead = self.source.randint(0, 2**32, size=max(4096, 2 * count), dtype=np.uint32)
            found = self.ahead >> np.uint32(32 - bits)
            good = np.flatnonzero(found < bound)[: count - len(out)]
            used = good[-1] + 1 if len(out) + len(good) == count else len(self.ahead)
            out = np.r_[out, found[good].astype(np.int64)]
            self.ahead = self.ahead[used:]
        return out


def resampled_interval(parts: list[np.ndarray], seed: int, repetitions: int = 10_000) -> tuple[float, float]:
    """95 % interval, in points, of the mean over parts of each part's mean, resampled with Python's generator.

    A repetition draws as many of each part as it has, one part after another.
    """
    draws = Draws(seed)
    means = np.sort([np.mean([p[draws.below(len(p), len(p))].sum() / len(p) for p in parts]) for _ in range(repetitions)])
    return 100 * float(means[int(0.025 * repetitions)]), 100 * float(means[int(0.975 * repetitions) - 1])


def paired_intervals(outcomes: DataFrame, group: str, part: str, sample: str, delta: str, seed: Column, repetitions: int = 10_000) -> DataFrame:
    """``(group, seed, low_pp, high_pp)``: :func:`resampled_interval` of each group over its parts (in their order).

    ``delta`` is -1, 0 or 1 a sample; samples are taken in the order of their ids.
    With one part a group this is the interval of a class, with two that of a mean
    of classes. Null deltas and groups don't count.
    """
    rows = outcomes.filter(F.col(delta).isNotNull() & F.col(group).isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(delta).cast("tinyint").alias("d"))))["d"].alias("deltas")
    arrays = rows.groupBy(F.col(group).alias("g"), F.col(part).alias("part"), seed.cast("bigint").alias("seed")).agg(ordered)
    arrays = arrays.groupBy("g", "seed").agg(F.array_sort(F.collect_list(F.struct("part", "deltas")))["deltas"].alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [resampled_interval([np.array(p, np.int64) for p in parts], int(seed), repetitions) for parts, seed in zip(pdf["parts"], pdf["seed"])]
            yield pd.DataFrame({"g": pdf["g"], "seed": pdf["seed"], "low_pp": [x[0] for x in found], "high_pp": [x[1] for x in found]})

    kind = outcomes.schema[group].dataType.simpleString()
    return arrays.mapInPandas(run, f"g {kind}, seed bigint, low_pp double, high_pp double").withColumnRenamed("g", group)


def compared_classes(pairs: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Per class both numbers of right outcomes, accuracies in percent, their difference, moves, and the exact p-value.

    Null outcomes are wrong.
    """
    was, now = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    counted = pairs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(was).alias("baseline_correct"), F.count_if(now).alias("candidate_correct"),
        F.count_if(~was & now).alias("improved"), F.count_if(was & ~now).alias("regressed"), F.count_if(was == now).alias("unchanged"),
    )
    percent = lambda c: F.lit(100.0) * F.col(c) / F.col("total")
    return counted.withColumns({
        "baseline_percent": percent("baseline_correct"), "candidate_percent": percent("candidate_correct"),
        "delta_pp": F.lit(100.0) * (F.col("candidate_correct") - F.col("baseline_correct")) / F.col("total"),
        "p_value": F.round(stats.mcnemar(F.col("improved"), F.col("regressed")), 9),
    })


def unpaired_samples(before: DataFrame, after: DataFrame, sample: str) -> DataFrame:
    """Samples that the sides hold in different numbers, with ``surplus`` of the first: a comparison needs none."""
    signed = before.select(sample, F.lit(1).alias("n")).unionByName(after.select(sample, F.lit(-1).alias("n")))
    return signed.groupBy(sample).agg(F.sum("n").alias("surplus")).filter("surplus <> 0")


def checkpoint_rows(classes: DataFrame, step: str, language: str) -> DataFrame:
    """A row per checkpoint: lowest class and language-mean differences, and whether it is unchanged or declines.

    ``classes`` as of :func:`compared_classes`, of each step and language. A
    decline is confirmed if the next checkpoint declines too.
    """
    macro = classes.groupBy(step, language).agg((F.avg("candidate_percent") - F.avg("baseline_percent")).alias("macro"), F.min("delta_pp").alias("lowest"))
    rows = macro.groupBy(step).agg(F.round(F.min("macro"), 9).alias("lowest_macro_pp"), F.round(F.min("lowest"), 9).alias("lowest_class_pp"))
    low, cls = F.col("lowest_macro_pp"), F.col("lowest_class_pp")
    rows = rows.withColumn("almost_unchanged", (low >= FLOORS[0]) & (cls >= FLOORS[1])).withColumn("decline", (low < LIMITS[0]) | (cls < LIMITS[1]))
    return rows.withColumn("confirmed", F.col("decline") & F.coalesce(F.lead("decline").over(Window.partitionBy(F.lit(0)).orderBy(step)), F.lit(False)))


def chosen_steps(rows: DataFrame, macros: DataFrame, step: str, first: str, second: str) -> DataFrame:
    """One row: first and last unchanged step, first confirmed decline, and the best step.

    ``rows`` as of :func:`checkpoint_rows`; ``macros``: step and the mean accuracies
    and differences of two languages (``<language>_percent``, ``<language>_pp``).
    Best is the highest mean of the second language among steps at which the first
    drops by a point or less, the smaller step of equals.
    """
    # a struct's max takes the larger step of equals, so that is negated
    best = F.max(F.when(F.col(f"{first}_pp") >= -1.0, F.struct(F.col(f"{second}_percent").alias("v"), (-F.col(step)).alias("s"))))
    top = macros.agg((-best["s"]).alias("best_step"))
    marks = rows.agg(
        F.min(F.when(F.col("almost_unchanged"), F.col(step))).alias("first_unchanged"), F.max(F.when(F.col("almost_unchanged"), F.col(step))).alias("last_unchanged"),
        F.min(F.when(F.col("confirmed"), F.col(step))).alias("first_confirmed_decline"),
    )
    return marks.join(top)  # one row each


def gated(accuracies: DataFrame, targets: DataFrame, keys: list[str], tolerance: float = GATE) -> DataFrame:
    """Accuracies (``correct``, ``total``) against ``target_percent`` by class: difference, and whether it is within the tolerance.

    A class without a target, or a target without results, is not within.
    """
    joined = accuracies.join(targets, keys, "full_outer")
    percent = F.lit(100.0) * F.col("correct") / F.col("total")
    away = percent - F.col("target_percent")
    return joined.select(*keys, percent.alias("percent"), "target_percent", away.alias("away_pp"), F.coalesce(F.abs(away) <= tolerance + 1e-12, F.lit(False)).alias("within"))


def subgroup_accuracy(records: DataFrame, path: str, component: str, label: Column, correct: Column) -> DataFrame:
    """Right outcomes by label and by whether a component of the path has the name."""
    inside = F.coalesce(F.array_contains(F.split(F.col(path), "/"), component), F.lit(False))
    right = F.count_if(F.coalesce(correct, F.lit(False)))
    rows = records.groupBy(label.alias("label"), F.when(inside, component).otherwise("other").alias("subgroup"))
    return rows.agg(right.alias("correct"), F.count("*").alias("total"), (F.lit(100.0) * right / F.count("*")).alias("percent"))


def guard_trajectory(heads: DataFrame, run: str, step: str, head: str) -> DataFrame:
    """Per run and step the largest drop of a head's accuracy since the first step, and whether it is safe.

    ``heads``: a row per run, step and head with ``accuracy``. A head that a step
    lacks has dropped to nothing. A run has few steps and heads.
    """
    base = heads.groupBy(run, head).agg(F.min_by("accuracy", step).alias("baseline"))
    grid = base.join(heads.select(run, step).distinct(), run).join(heads.select(run, step, head, "accuracy"), [run, step, head], "left")
    rows = grid.groupBy(run, step).agg(F.round(F.max(F.col("baseline") - F.coalesce("accuracy", F.lit(0.0))), 9).alias("largest_drop"))
    return rows.withColumn("safe", F.col("largest_drop") <= SAFE_DROP)


def chosen_rate(trajectory: DataFrame, finals: DataFrame, run: str, step: str, rate: str = "peak_lr", objective: str = "objective") -> DataFrame:
    """The run to go on with: one row of ``run``, ``rate``, ``reason``.

    ``trajectory`` as of :func:`guard_trajectory`; ``finals``: run, rate and final
    objective. A run is eligible if its last step is safe and its objective finite.
    The lowest objective wins; of the two lowest the lower rate, if they are within
    1 %. If none is eligible, the run that stayed safe longest, then the lower rate.
    Runs without a safe step are an error in that case and come out with a null step.
    """
    runs = trajectory.groupBy(run).agg(F.max_by("safe", step).alias("safe_end"), F.max(F.when(F.col("safe"), F.col(step))).alias("safe_step"))
    finite = F.col(objective).isNotNull() & ~F.isnan(objective) & (F.abs(objective) < float("inf"))
    rows = finals.join(runs, run).withColumn("eligible", F.col("safe_end") & finite)
    everything = Window.partitionBy(F.lit(0))  # one row a candidate
    rows = rows.withColumn("any", F.max("eligible").over(everything))
    order = [F.desc("eligible"), F.when(F.col("any"), F.col(objective)).otherwise(-F.col("safe_step")).asc_nulls_last(), F.asc(rate)]
    rows = rows.withColumn("place", F.row_number().over(everything.orderBy(*order)))
    top = everything.orderBy("place")
    rows = rows.withColumn("second_rate", F.lead(F.when(F.col("eligible"), F.col(rate))).over(top)).withColumn("second_objective", F.lead(objective).over(top)).withColumn("second_run", F.lead(run).over(top))
    near = F.coalesce((F.col("second_objective") - F.col(objective)) / F.col(objective) <= TIE, F.lit(False)) & F.col("any")
    swap = near & (F.col("second_rate") < F.col(rate))
    reason = F.when(near & F.col("second_rate").isNotNull(), "within 1 %: lower rate").when(F.col("any"), "lowest objective").otherwise("longest safe")
    return rows.filter("place = 1").select(
        F.when(swap, F.col("second_run")).otherwise(F.col(run)).alias(run), F.when(swap, F.col("second_rate")).otherwise(F.col(rate)).alias(rate), reason.alias("reason")
    )


def weighted_heads(rows: DataFrame, keys: list[str], head: str, loss: str, count: str, weights: DataFrame) -> DataFrame:
    """Per key the objective over heads: each head's loss weighted by its number of targets, then by the head's weight.

    ``rows``: loss and number of targets by head; ``weights``: ``head``, ``weight``.
    Also the plain mean over heads. Heads without a weight count as 0 in the
    objective.
    """
    per = rows.groupBy(*keys, F.col(head).alias("head")).agg((F.sum(F.col(loss) * F.col(count)) / F.sum(count)).alias("head_loss"), F.sum(count).alias("targets"))
    joined = per.join(weights, "head", "left")
    return joined.groupBy(*keys).agg(
        F.round(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("head_loss")), 9).alias("objective"),
        F.round(F.avg("head_loss"), 9).alias("macro_loss"), F.sum("targets").alias("targets"),
    )


def trace_mismatches(traces: DataFrame, inventory: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """Places at which results and inventory differ in a column, or that one of them lacks, with ``fault``."""
    left = traces.select(place, *[F.col(c).alias(f"{c}_is") for c in columns], F.lit(True).alias("traced"))
    right = inventory.select(place, *[F.col(c).alias(f"{c}_should") for c in columns], F.lit(True).alias("listed"))
    both = left.join(right, place, "full_outer")
    differ = [F.when(~F.col(f"{c}_is").eqNullSafe(F.col(f"{c}_should")), c) for c in columns]
    fault = F.when(F.col("traced").isNull(), "untraced").when(F.col("listed").isNull(), "unlisted").otherwise(F.coalesce(*differ))
    return both.select(place, fault.alias("fault")).filter("fault is not null")
