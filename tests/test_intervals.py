import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators.intervals import interval_gaps, merge_intervals, periods_and_gaps

SCHEMA = "k string, start bigint, stop bigint, kind string"


def brute(rows):
    out, keys = set(), {r[0] for r in rows if r[0] is not None}
    for k in keys:
        spans = sorted((a, b) for key, a, b, *_ in rows if key == k and a is not None and b is not None and b > a)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["k"], block).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [8, 64, 65_536])
def test_random_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for _ in range(400):
        a = rng.randrange(-60, 300)
        rows.append((rng.choice("abc"), a, a + rng.choice([0, 1, 2, 3, 8, 16, 40]), "x"))
    rows += [("a", None, 5, "x"), (None, 1, 5, "x"), ("b", 9, None, "x"), ("c", 9, 3, "x"), *rows[:20]]
    assert run(spark, rows, block) == brute(rows)


def test_touching_nested_and_block_borders(spark):
    rows = [("a", 0, 8, ""), ("a", 8, 16, ""), ("a", 16, 17, ""), ("a", 2, 3, ""), ("b", 0, 24, ""), ("b", 25, 26, ""), ("d", 7, 9, ""), ("d", 15, 16, ""), ("d", 17, 18, "")]
    assert run(spark, rows, 8) == brute(rows)


def test_one_hot_key(spark):
    rows = [("hot", 3 * i, 3 * i + 2, "") for i in range(3000)] + [("hot", 0, 1, "")] * 500
    assert run(spark, rows, 256) == brute(rows)


def test_empty_and_parts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty, ["k"]).count() == 0
    df = spark.createDataFrame([("a", 0, 5, ""), ("a", 9, 10, "")], SCHEMA)
    assert merge_intervals(df, ["k"]).columns == ["k", "start_at", "stop_at"]
    assert [tuple(r) for r in interval_gaps(df, ["k"]).collect()] == [("a", 5, 9)]


def test_any_length_and_place(spark):
    top, low = 2**63 - 1, -(2**63)
    rows = [("a", 0, 2**36 + 2, ""), ("a", 5, 9, ""), ("a", 2**36 + 2, 2**36 + 4, ""), ("a", 2**60, 2**62, ""), ("a", 2**61, 2**61 + 1, "")]
    rows += [("b", low, low + 2, ""), ("b", low + 3, top - 1, ""), ("b", top - 1, top, ""), ("c", low, top, ""), ("c", 5, 6, ""), ("d", -5, 2**50, ""), ("d", 2**50 + 1, 2**50 + 2, "")]
    for block in (8, 2**20):
        assert run(spark, rows, block) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_blocks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        a = rng.randrange(-4000, 4000)
        rows.append((rng.choice("ab"), a, a + rng.choice([1, 3, 9, 30, 700 if rng.random() < 0.05 else 2]), "x"))
    got = [tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["k"], 4, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_key_of_any_name(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 9, 10)], "block string, start bigint, stop bigint")
    assert sorted(tuple(r) for r in periods_and_gaps(df, ["block"]).collect()) == [("a", "gap", 5, 9), ("a", "period", 0, 5), ("a", "period", 9, 10)]


def test_bounds(spark):
    from turnloom.functions.bounds import valid_pair, valid_pairs

    nan, inf = float("nan"), float("inf")
    cases = [[0.0, 160.0], [159.9999999, 161.0000001], [5.0], [], None, [3.0, 3.0], [3.2, 3.4], [9.0, 1.0], [nan, 4.0], [1.0, inf], [None, 4.0], [1.0, 1e300], [-0.5, 0.49999999999999994], [2.0**60, 2.0**61]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, p array<double>")
    got = {r[0]: r[1] and tuple(r[1]) for r in df.select("i", valid_pair(F.col("p"))).collect()}
    assert got == {0: (0, 160), 1: (160, 161), **{i: None for i in range(2, 11)}, 11: (1, 2**63 - 1024), 12: (-1, 0), 13: (2**60, 2**61)}
    one = spark.createDataFrame([(cases,), (None,)], "p array<array<double>>")
    assert [len(r[0]) for r in one.select(valid_pairs(F.col("p"))).collect()] == [5, 0]
