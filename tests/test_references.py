import random
from datetime import datetime, timedelta

from turnloom.operators.references import orphan_references

REFS = "kind string, field string, row_key string, key string, at timestamp_ntz, deleted string"
PARENTS = "kind string, key string, arrived timestamp_ntz, deleted timestamp_ntz"


def brute(refs, parents):
    out = set()
    for kind, field, row, key, at, *_ in refs:
        if key is None or at is None:
            continue
        own = [(a, d) for k, p, a, d in parents if (k, p) == (kind, key)]
        if any(a and a <= at and (d is None or d > at) for a, d in own):
            continue
        firsts = [a for a, _ in own if a]
        reason = "missing" if not own else "late" if not firsts or min(firsts) > at else "deleted"
        out.add((field, row, key, reason, at.strftime("%Y-%m")))
    return out


def check(spark, refs, parents):
    got = [tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(refs, parents)
    return got


def test_random(spark):
    rng, start = random.Random(1), datetime(2025, 1, 1)
    moment = lambda: start + timedelta(hours=rng.randrange(0, 24 * 150))
    keys = [f"k{i}" for i in range(60)]
    parents = []
    for k in keys[:45]:
        for _ in range(rng.choice([1, 1, 2, 3])):
            a = moment()
            parents.append((rng.choice("ev"), k, a, rng.choice([None, None, a + timedelta(days=rng.randrange(0, 90))])))
    parents += [("e", "k50", None, None), ("v", None, moment(), None)]
    refs = [(rng.choice("ev"), "f", f"r{i}", rng.choice(keys + [None]), rng.choice([moment(), moment(), None]), "") for i in range(500)]
    refs += [("e", "f", f"h{i}", "nowhere", moment(), "") for i in range(300)]  # one key of a third of all
    assert check(spark, refs + refs[:30], parents)


def test_edges(spark):
    t = datetime(2025, 3, 1)
    refs = [("e", "f", "a", "x", t, ""), ("e", "f", "b", "x", t - timedelta(microseconds=1), ""), ("e", "f", "c", "y", t, ""), ("e", "f", "d", "z", t, "")]
    parents = [("e", "x", t, None), ("e", "y", t - timedelta(days=40), t), ("e", "z", t - timedelta(days=40), t + timedelta(microseconds=1))]
    assert {(r[1], r[3]) for r in check(spark, refs, parents)} == {("b", "late"), ("c", "deleted")}


def test_empty(spark):
    t = datetime(2025, 3, 1)
    assert not check(spark, [], [("e", "x", t, None)])
    assert len(check(spark, [("e", "f", "a", "x", t, "")], [])) == 1
