import random
import re

from pyspark.sql import functions as F

from turnloom.operators import contracts, packing
from turnloom.plans import pipeline


def test_views_timelines_export(spark):
    sources = spark.createDataFrame([("s", 2, 6, "x"), ("s", 2, 6, "x"), ("mono", 1, 6, "x"), ("none", 2, 0, "x")], "source_id string, ntrack int, chunk_count bigint, tracks string")
    segs = lambda *x: [list(map(float, p)) for p in x]
    events = spark.createDataFrame(
        [("s/0", "s", 0, "complete", segs((0, 320), (0, 320))), ("s/1", "s", 1, "incomplete", segs((160, 480))), ("s/2", "s", 0, "backchannel", segs((640, 5000))), ("q", "gone", 0, "wait", segs((0, 9))), ("n", "s", 0, "wait", None)],
        "event_id string, source_id string, channel int, final_state string, speaker_segments_ms array<array<double>>",
    )
    views = pipeline.build_views(sources, events)
    got = {r["view_id"]: r for r in views.collect()}
    assert sorted(got) == ["s/target-ch00", "s/target-ch01"]
    assert got["s/target-ch00"]["target_active_by_chunk"] == [True, True, False, False, True, True]
    assert got["s/target-ch00"]["other_active_count_by_chunk"] == [0, 1, 1, 0, 0, 0]
    assert got["s/target-ch01"]["overlap_by_chunk"] == [False, True, False, False, False, False]
    lines, lost = pipeline.build_timelines(views, events.filter("event_id <> 's/1'"))
    states = {r["view_id"]: r["chunk_states"] for r in lines.collect()}
    assert states["s/target-ch00"] == ["user_nonidle", "user_nonidle", "user_complete", "user_idle", "user_backchannel", "user_backchannel"]
    assert states["s/target-ch01"][1:3] == [None, None]
    assert [tuple(r) for r in lost.collect()] == [("s/target-ch01", "uncovered", 1, 3)]


def test_export_is_complete(spark):
    rng = random.Random(9)
    rows = []
    for v in range(12):
        n = rng.randrange(1, 40)
        states = [rng.choice([*packing.STATES, *packing.STATES, None]) for _ in range(n)]
        texts = [rng.choice(["", "ab", "你好", "x" * 30, "a<|b", None]) for _ in range(n)]
        rows.append((f"v{v}", "s", v, states, texts, [[i, i + 1] for i in range(n)], [True] * n, [False] * n))
    schema = "view_id string, source_id string, channel int, chunk_states array<string>, chunk_texts array<string>, chunk_audio array<array<int>>, other_active_by_chunk array<boolean>, overlap_by_chunk array<boolean>"
    got = pipeline.export_sequences(spark.createDataFrame(rows, schema), 30).collect()
    control = re.compile(r"<\|[^<|>]+\|>")
    covered = {}
    for r in got:
        lo, hi = r["chunk_range"]
        assert len(control.sub("x", r["sequence"])) == r["tokenized_length"] <= 30 and r["chunk_count"] == hi - lo == r["other_active_chunk_count"]
        covered.setdefault(r["view_id"], []).extend(range(lo, hi))
    valid = spark.createDataFrame([(r["sequence"],) for r in got], "s string").filter(packing.is_sequence(F.col("s"))).count()
    assert valid == len(got)
    for view, _, _, states, texts, *_ in rows:
        fit = [i for i, (s, t) in enumerate(zip(states, texts)) if s and "<|" not in (t or "") and len(t or "") + 4 + 2 <= 30]
        assert sorted(covered.get(view, [])) == fit


def test_contracts(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2), ([1, 2, 3], 2), ([1, 60_000], 1), ([], 0), (None, 1), ([1, None], 1)], "t array<int>, n int")
    assert [r[0] for r in df.select(contracts.chunk_tokens(F.col("t"), F.col("n"))).collect()] == [[[1, 2], [3, 4]], None, None, [], None, None]
    ids = [[1, 2, 10, 11, 50, 90, 70, 12, 13, 90, 71], [1, 2, 10, 50, 90, 70], [1, 2], [2, 1, 10, 11, 90, 70], [1, 2, 10, 11, 90], []]
    df = spark.createDataFrame([(x,) for x in ids], "t array<int>")
    got = [r[0] and tuple(r[0]) for r in df.select(contracts.sequence_groups(F.col("t"), [1, 2], (10, 40), 90, [70, 71])).collect()]
    assert got == [(2, 1), None, None, None, None, None]
    step = lambda i, s="idle", off=0.0: (s, [i * 0.16 + off, (i + 1) * 0.16])
    traces = [[step(0), step(1)], [], [step(0, "huh")], [step(0), step(1, off=0.01)], [("idle", [0.0])], None]
    df = spark.createDataFrame([(t,) for t in traces], "t array<struct<state string, timestamp array<double>>>")
    assert [r[0] for r in df.select(contracts.trace_faults(F.col("t"))).collect()] == [[], ["empty"], ["state"], ["time"], ["time"], ["empty"]]
    rows, wanted = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    kept, bad = contracts.selected(rows, wanted, "k")
    assert [r[0] for r in kept.collect()] == ["a"] and sorted(map(tuple, bad.collect())) == [("a", "repeated"), ("z", "unknown")]
    series = spark.createDataFrame([("a", 1, 0.5, -3.0), ("a", 2, 0.5, 0.0), ("b", 1, -4.0, 0.0)], "k string, s int, m double, c double")
    assert sorted(map(tuple, contracts.stable_and_declining(series, ["k"], "m", "c").collect())) == [("a", False, False), ("b", False, True)]
    assert sorted(map(tuple, contracts.best_step(series, ["k"], "m", "s").collect())) == [("a", 1, 0.5), ("b", 1, -4.0)]
    named = spark.createDataFrame([("x", True), (None, False), ("x", False)], "o string, r boolean")
    assert [r[0] for r in named.select(contracts.label_context(F.col("o"), F.col("r"))).collect()] == ["TO_LABEL", "UNLABELED_NOT_REQUESTED", "x"]
