"""Contracts between stages: totals, versions, tokenizer ids, one-to-one joins, closures, and small choices."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_faults(found: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals that differ from those expected, as ``found`` and ``expected``; an absent one counts as 0. Null keys are equal."""
    none = F.lit(0).cast("bigint")
    signed = found.select(*keys, F.col(value).cast("bigint").alias("found"), none.alias("expected"))
    signed = signed.unionByName(expected.select(*keys, none.alias("found"), F.col(value).cast("bigint").alias("expected")))
    return signed.groupBy(*keys).agg(F.sum("found").alias("found"), F.sum("expected").alias("expected")).filter("found <> expected")


def version_drift(expected: DataFrame, actual: DataFrame, suffixed: tuple[str, ...] = ("torch",)) -> DataFrame:
    """Packages (``package``, ``version``) that are absent or of another version, with ``actual``.

    Those in ``suffixed`` may carry a build suffix of the form ``+cu``.
    """
    joined = expected.join(actual.select("package", F.col("version").alias("actual")), "package", "left")
    same = F.col("actual") == F.col("version")
    built = F.col("package").isin(*suffixed) & F.col("actual").startswith(F.concat("version", F.lit("+cu")))
    return joined.filter(~F.coalesce(same | built, F.lit(False)))


def tokenizer_faults(ids_of: Callable[[str], list[int]], expected: dict[str, int]) -> list[str]:
    """Control tokens that the tokenizer doesn't give exactly the one id expected for."""
    return sorted(token for token, want in expected.items() if list(ids_of(token)) != [want])


def one_to_one(left: DataFrame, right: DataFrame, key: str, equal: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides joined on the key, and faults.

    Faults (``key``, ``fault``): a key of one side only (``left``, ``right``), one
    that a side holds more than once (``repeated``), and a column of ``equal`` that
    differs (its name). Only rows without fault are joined.
    """
    a = left.groupBy(key).agg(F.count("*").alias("n"), *[F.first(c).alias(f"{c}_l") for c in equal])
    b = right.groupBy(key).agg(F.count("*").alias("m"), *[F.first(c).alias(f"{c}_r") for c in equal])
    differ = [F.when(~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")), c) for c in equal]
    fault = F.when(F.col("m").isNull(), "left").when(F.col("n").isNull(), "right").when((F.col("n") > 1) | (F.col("m") > 1), "repeated").otherwise(F.coalesce(*differ, F.lit(None)))
    judged = a.join(b, key, "full_outer").select(key, fault.alias("fault"))
    good = judged.filter("fault is null").select(key)
    more = [c for c in right.columns if c != key and c not in left.columns]
    return left.join(good, key, "left_semi").join(right.select(key, *more), key), judged.filter("fault is not null")


def chunk_closure(lengths: DataFrame, exported: DataFrame, lost: DataFrame) -> DataFrame:
    """Per view the chunks it has, those exported and those quarantined; ``closed`` if each is in exactly one.

    ``lengths``: ``view_id``, ``size``; ``exported`` and ``lost``: half-open ranges
    ``view_id``, ``start``, ``stop``. Ranges of a view that meet are no closure.
    Counted by their ends, with no chunk made a row: cover of a range is the running
    sum of starts less stops, within a view's own ranges.
    """
    ranges = exported.select("view_id", "start", "stop", F.lit(1).alias("out")).unionByName(lost.select("view_id", "start", "stop", F.lit(0).alias("out"))).filter("start < stop")
    sums = ranges.groupBy("view_id").agg(
        F.sum(F.when(F.col("out") == 1, F.col("stop") - F.col("start")).otherwise(0)).alias("exported"),
        F.sum(F.when(F.col("out") == 0, F.col("stop") - F.col("start")).otherwise(0)).alias("quarantined"),
        F.min("start").alias("low"), F.max("stop").alias("high"),
    )
    along = Window.partitionBy("view_id").orderBy("start", "stop")
    meeting = ranges.withColumn("before", F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))).groupBy("view_id").agg(F.coalesce(F.max(F.col("before") > F.col("start")), F.lit(False)).alias("meets"))
    joined = lengths.select("view_id", "size").join(sums, "view_id", "left").join(meeting, "view_id", "left")
    none = F.lit(0).cast("bigint")
    out = joined.select("view_id", "size", F.coalesce("exported", none).alias("exported"), F.coalesce("quarantined", none).alias("quarantined"), F.coalesce("meets", F.lit(False)).alias("meets"), F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"))
    closed = ~F.col("meets") & (F.col("exported") + F.col("quarantined") == F.col("size")) & (F.col("low") == 0) & (F.col("high") == F.col("size"))
    return out.select("view_id", "size", "exported", "quarantined", (closed | ((F.col("size") == 0) & (F.col("high") == 0))).alias("closed"))


def placed_slice(rows: DataFrame, place: str, start: int, count: int) -> DataFrame:
    """Rows at places ``start .. start + count``; an error if there are none so far out."""
    if start < 0 or count < 1:
        raise ValueError("start is from 0, count from 1")
    found = rows.filter((F.col(place) >= start) & (F.col(place) < start + count))
    if found.select(place).distinct().limit(count).count() < count:
        raise ValueError(f"no {count} rows from {start} on")
    return found


def covering_choice(rows: DataFrame, key: str, length: str, has: dict[str, Column], least: dict[str, Column], count: int) -> list[tuple]:
    """Greedy choice of ``count`` rows that cover all names of ``has``: most new names first, then the shorter, then the smaller key.

    Only rows with a name of ``least`` are taken. Rows with the same names are alike
    but for length and key, so the first ``count`` of each set of names are all that
    the choice can need: at most ``count`` rows for each of the 2**n sets, whatever
    the table's size, come to the driver. An error if rows are too few or a name
    stays uncovered.
    """
    names = sorted(has)
    held = F.array_compact(F.array(*[F.when(has[n], n) for n in names]))
    some = F.lit(False)
    for c in least.values():
        some |= c
    first = Window.partitionBy("held").orderBy(length, key)
    short = rows.filter(some).select(key, length, held.alias("held")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= count)
    options = [(r[0], r[1], frozenset(r[2])) for r in short.collect()]
    chosen, covered = [], set()
    for _ in range(count):
        if not options:
            raise ValueError("too few rows")
        best = min(options, key=lambda x: (-len(x[2] - covered), x[1], x[0]))
        options.remove(best)
        chosen.append(best[:2])
        covered |= best[2]
    if covered != set(names):
        raise ValueError(f"not covered: {sorted(set(names) - covered)}")
    return chosen


class SeededStream:
    """Endless passes over ``size`` places, each shuffled by Python's generator; ``state`` lets another one go on from here."""

    def __init__(self, size: int, seed: int, state: dict | None = None):
        self.size, self.rng = size, random.Random(seed)
        self.order, self.at, self.epoch = [], 0, -1
        if state:
            self.order, self.at, self.epoch = list(state["order"]), state["at"], state["epoch"]
            self.rng.setstate(state["rng"])

    def __iter__(self) -> Iterator[int]:
        return self

    def __next__(self) -> int:
        if self.at == len(self.order):
            self.order = list(range(self.size))
            self.rng.shuffle(self.order)
            self.at, self.epoch = 0, self.epoch + 1
        self.at += 1
        return self.order[self.at - 1]

    @property
    def state(self) -> dict:
        return {"order": self.order, "at": self.at, "epoch": self.epoch, "rng": self.rng.getstate()}


def migrated(kept: DataFrame, key: str, signature: Column, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Cache entries under the signature they have now, and those refused.

    Entries that are not valid, or share their new signature with another content
    (``clash``), are refused with their ``fault``; of equal ones one stays.
    """
    signed = kept.withColumn("_new", signature)
    judged = signed.withColumn("fault", F.when(~F.coalesce(valid, F.lit(False)), "invalid"))
    content = F.xxhash64(*[c for c in kept.columns if c != key])
    clashes = judged.filter("fault is null").groupBy("_new").agg(F.min(content).alias("a"), F.max(content).alias("b")).filter("a <> b").select("_new", F.lit(True).alias("clash"))
    judged = judged.join(clashes, "_new", "left").withColumn("fault", F.when(F.col("clash"), "clash").otherwise(F.col("fault")))
    good = judged.filter("fault is null").withColumn(key, F.col("_new")).drop("_new", "fault", "clash").dropDuplicates([key])
    return good, judged.filter("fault is not null").drop("_new", "clash")
