import math

import pytest
from pyspark.sql import functions as F

from turnloom.functions import hashing
from turnloom.functions.bounds import chunk_range
from turnloom.functions.ids import clean_id
from turnloom.operators import annotations, cache, checks, grid, labels, packing, readout, sampling, stats, timeline, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_chunk_bounds(spark):
    df = spark.createDataFrame([(100.0, 300.0), (480.0, 481.0), (320.0, 639.5), (7000.0, 7001.0), (161.0, 161.0), (-90.0, 170.0)], "s double, e double")
    lo, hi = chunk_range(F.col("s"), F.col("e"), F.lit(4))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0, 2), (3, 4), (2, 4), (4, 4), (1, 1), (0, 2)]


def test_ids(spark):
    df = spark.createDataFrame([(" DLG--1\t",), ("　",), ("",), (None,), (" x ",)], "x string")
    assert [r[0] for r in df.select(clean_id(F.col("x"))).collect()] == ["dlg--1", None, None, None, "x"]


def test_rest_arrays_and_ranges(spark):
    tracks = [[False, True, True, False, True], [True, True, False, False, None], [True, True, False, False, False]]
    df = spark.createDataFrame([(tracks,), ([],)], "t array<array<boolean>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(grid.rest_arrays(F.col("t"), F.lit(0))).collect()]
    assert got == [[(True, 2, False), (True, 2, True), (False, 0, False), (False, 0, False), (False, 0, False)], []]
    flags = spark.createDataFrame([([True, True, None, True, False],), ([],), (None,)], "f array<boolean>")
    got = [r[0] and [tuple(x) for x in r[0]] for r in flags.select(grid.true_ranges(F.col("f"))).collect()]
    assert got[:2] == [[(0, 2), (3, 4)], []] and not got[2]


def test_activity_cells(spark):
    df = spark.createDataFrame([("v", 10.0, 170.0, 4), ("v", 480.0, 500.0, 4), ("v", 5.0, 5.0, 4), ("v", float("nan"), 3.0, 4), ("v", None, 3.0, 4)], "k string, start double, stop double, n int")
    assert [r[1] for r in rows(grid.chunk_cells(df, ["k"], chunks="n"))] == [0, 1, 3]


def test_overlap_pairs(spark):
    left = spark.createDataFrame([("v", "a", 0, 300), ("v", "b", 5, 5), ("w", "c", 0, 9)], "k string, left_id string, lo int, hi int")
    right = spark.createDataFrame([("v", "x", 299, 310), ("v", "y", 300, 310), ("v", "z", 100, 200)], "k string, right_id string, lo int, hi int")
    assert rows(grid.overlap_pairs(left, right, "k", 64)) == [("v", "a", "x"), ("v", "a", "z")]


def _resolved(spark, events, chunks, active):
    cells = spark.createDataFrame([("v", e, c) for e, _, cs in events for c in cs], "view_id string, event_id string, chunk bigint")
    states = spark.createDataFrame([(e, s) for e, s, _ in events], "event_id string, state string")
    grid_ = spark.createDataFrame([("v", chunks)], "view_id string, chunk_count bigint")
    on = spark.createDataFrame([("v", c) for c in active], "view_id string, chunk bigint")
    got = timeline.resolve(timeline.claims(cells, states), grid_, on)
    return [(r["state"], r["problem"]) for r in got.orderBy("chunk").collect()]


def test_timeline(spark):
    assert _resolved(spark, [("a", "complete", [0])], 3, [0]) == [("user_nonidle", None), ("user_complete", None), ("user_idle", None)]
    assert _resolved(spark, [("a", "backchannel", [0])], 2, [0])[0] == ("user_backchannel", None)
    assert len(_resolved(spark, [("a", "incomplete", [0])], 1, [0])) == 2
    assert _resolved(spark, [("a", "complete", [0]), ("b", "incomplete", [1])], 3, [0, 1])[1] == (None, "conflict")
    assert _resolved(spark, [("a", "complete", [0])], 3, [0, 1])[1] == (None, "uncovered")


def brute_pack(costs, budget, prefix):
    out, start, cost = [], 0, prefix
    for i, c in enumerate(costs):
        if prefix + c > budget:
            if i > start:
                out.append((start, i, float(cost)))
            start, cost = i + 1, prefix
            continue
        if i > start and cost + c > budget:
            out.append((start, i, float(cost)))
            start, cost = i, prefix
        cost += c
    if start < len(costs):
        out.append((start, len(costs), float(cost)))
    return out


def test_packing(spark):
    import random

    rng = random.Random(7)
    cases = [[rng.randrange(1, 14) for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [[], [99], [5, 99, 5], [10, 1]]
    df = spark.createDataFrame([(c,) for c in cases], "c array<int>")
    got = [[tuple(x) for x in r[0]] for r in df.select(packing.greedy_windows(F.col("c"), 12, 2)).collect()]
    assert got == [brute_pack(c, 12, 2) for c in cases]
    left = [r[0] for r in df.select(packing.oversized(F.col("c"), 12, 2)).collect()]
    assert left == [[i for i, x in enumerate(c) if x + 2 > 12] for c in cases]


def test_groups_and_grammar(spark):
    df = spark.createDataFrame([(1, 2, "你好", "user_complete"), (1, 2, "a<|b", "user_complete"), (1, 60000, "x", "user_idle"), (1, 2, "x", "idle"), (1, 2, None, "user_idle")], "a int, b int, t string, s string")
    got = [r[0] for r in df.select(packing.group_text(F.col("a"), F.col("b"), F.col("t"), F.col("s"))).collect()]
    assert got == ["<|audio_1|><|audio_2|>你好<|end_of_sentence|><|user_complete|>", None, None, None, None]
    seqs = spark.createDataFrame([(packing.PREFIX + got[0] * 3,), (got[0],), (packing.PREFIX,), (packing.PREFIX + got[0] + "x",), (None,)], "s string")
    assert [r[0] for r in seqs.select(packing.is_sequence(F.col("s"))).collect()] == [True, False, False, False, None]


def test_rendering(spark):
    data = [(0, i, t) for i, t in enumerate(["marketing", "data", "中", "文"])] + [(1, 0, "是"), (1, 1, "ABC"), (2, 0, "你"), (2, 1, "好"), (2, 2, None)]
    got = rows(tokens.render_groups(spark.createDataFrame(data, "g int, i int, t string"), ["g"], "i", "t"))
    assert [r[1] for r in got] == ["marketing data 中文", "是ABC", "你好"]


def test_tokens(spark):
    t = lambda *x: [dict(token=a, start_ms=b, end_ms=c) for a, b, c in x]
    data = [(t(("a", 0.0, 100.0), ("b", 50.0, 160.0)),), (t(("a", 100.0, 200.0), ("b", 50.0, 250.0)),), (t(("a", None, 3.0)),), (t(("<|x", 5.0, 3.0)),), ([],)]
    df = spark.createDataFrame(data, "t array<struct<token string, start_ms double, end_ms double>>")
    assert [r[0] for r in df.select(tokens.token_faults(F.col("t"), F.lit(300.0))).collect()] == [[], ["disorder"], ["untimed"], ["reversed", "control"], []]
    emit = spark.createDataFrame([(160.0,), (161.0,), (0.0,), (9999.0,)], "e double")
    assert [r[0] for r in emit.select(tokens.emit_chunk(F.col("e"), F.lit(3))).collect()] == [0, 1, 0, 2]
    active = [i == 5 for i in range(20)], [i == 2 for i in range(20)]
    near = spark.createDataFrame([(800.0, 2400.0, active[0]), (1600.0, 1760.0, active[1])], "s double, e double, a array<boolean>")
    assert [r[0] for r in near.select(tokens.has_activity(F.col("s"), F.col("e"), F.col("a"))).collect()] == [True, False]


def test_labels(spark):
    df = spark.createDataFrame([("<|wait|>",), (None,), ("",), ("<|idle|>",)], "x string")
    assert [tuple(r) for r in df.select(*labels.read_state(F.col("x"))).collect()] == [("wait", False), (None, False), (None, False), (None, True)]
    both = spark.createDataFrame([("wait", None), ("complete", "x"), (None, "incomplete"), (None, None)], "o string, s string")
    got = [tuple(r) for r in both.select(*labels.precedence(F.col("o"), F.col("s"))).collect()]
    assert got == [("complete", "wait_as_complete"), ("complete", "official"), ("incomplete", "substitute"), (None, "none")]
    given = [[("a", "complete", 0.5, "ok")], [("a", "idle", 2.0, "")], [("b", "wait", 1.0, "ok"), ("b", "wait", 1.0, "ok")]]
    df = spark.createDataFrame([(["a"], g) for g in given], "q array<string>, g array<struct<event_id string, state string, confidence double, reason string>>")
    assert [r[0] for r in df.select(labels.response_faults(F.col("q"), F.col("g"))).collect()] == [[], ["state", "confidence", "reason"], ["unanswered", "unasked", "repeated"]]


def test_checks(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(checks.key_differences(a, b, "k")) == [("x", "left"), ("z", "right")]
    assert rows(checks.bag_differences(a, b, ["k"])) == [("x", 1), ("y", 1), ("z", -1), (None, 1)]
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate([0, 5, 4, 4, 9, 8, 1])] + [("t", 99, None)], "k string, o int, v double")
    for span in (2, 3, 4096):
        assert [r[1] for r in rows(checks.order_violations(df, ["k"], ["o"], "v", span))] == [2, 5, 6]


def test_sampling(spark):
    df = spark.createDataFrame([(f"s{i:03d}",) for i in range(100)] * 2, "k string")
    got = {r["k"]: r["split"] for r in sampling.group_split(df, "k", 0.05).collect()}
    assert len(got) == 100 and sorted(got.values()).count("validation") == 5
    assert got == {r["k"]: r["split"] for r in sampling.group_split(df.orderBy(F.desc("k")), "k", 0.05).collect()}
    ranks = sorted(r["place"] for r in sampling.hashed_ranks(df, "k", 1).collect())
    assert ranks == list(range(1, 101))


def test_read_out(spark):
    data = [(0, "idle", 0.0), (0, "wait", 0.16), (0, "speak", 0.32), (0, "wait", 0.48), (1, "idle", 0.0)]
    df = spark.createDataFrame([(k, s, t, 0.35) for k, s, t in data] + [(2, "speak", 0.16, 1.0)], "k int, s string, t double, e double")
    got = {r["k"]: (r["last"], r["first"], r["closest"], r["after"]) for r in readout.read_out(df, ["k"], "s", "t", "e").collect()}
    assert got == {0: ("incomplete", "incomplete", "complete", "incomplete"), 1: ("none",) * 4, 2: ("complete", "complete", "complete", "none")}


def test_mcnemar(spark):
    cases = [(0, 0), (0, 6), (3, 5), (42, 49), (400, 300), (5000, 5000)]
    df = spark.createDataFrame(cases, "i bigint, r bigint")
    got = [r[0] for r in df.select(stats.mcnemar(F.col("i"), F.col("r"))).collect()]
    for p, (i, r) in zip(got, cases):
        n = i + r
        exact = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(i, r) + 1)) / 2**n)
        assert p == pytest.approx(exact, rel=1e-6)
    assert got[1] == pytest.approx(0.03125)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 0)] * 30 + [("b", 1)] * 10 + [("b", -1)] * 10, "g string, delta int")
    got = {r["g"]: (r["low_pp"], r["high_pp"]) for r in stats.bootstrap(df, "g").collect()}
    assert got["a"] == (100.0, 100.0) and got["b"][0] < 0 < got["b"][1]


def test_cache(spark):
    want, have = spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert rows(cache.hits(want, have, "k")) == [("a",)] and rows(cache.misses(want, have, "k")) == [("b",)]
    new = spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    once = cache.with_new(have, new, "k")
    assert rows(once) == rows(cache.with_new(once, new, "k")) == [("a", 1), ("b", 2)]


def test_hashing(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("é", None, 3)], "b string, a string, c int")
    got = df.select(hashing.canonical_json(b=F.col("b"), a=F.col("a"), c=F.col("c"))).first()[0]
    assert got == json.dumps({"a": None, "b": "é", "c": 3}, separators=(",", ":"), ensure_ascii=False)
    ids = df.select(hashing.list_identity(F.array(F.lit("y"), F.lit("x")))).first()[0]
    assert ids == hashlib.sha256(b'["x","y"]').hexdigest()


def test_annotations(spark):
    import json

    event = lambda a, b, **k: {"startInMs": a, "endInMs": b, "LID": "en", "state": "<|wait|>", "labels": {"txt": "hi"}, "speaker": {"segments": []}} | k
    cut = lambda *x: {"segments": [{"startSec": a, "endSec": b} for a, b in x]}
    first = [event(0, 500), event(400, 1008), event(500, 600), event("x", 700), event(100, 300), event(300, 1161), event(900, 1160.0, speaker=cut((0.9, 1.1605)))]
    second = [event(5, 5, state="<|x|>", speaker=cut((0, 0.5), (-0.0005, 0.1), (-5, 0.1), (0.9, 1.1), (0.9, 99), (0.7, 0.7), (None, 1)))]
    meta = {"nTrack": 2, "fs": 48000, "timeLenInSec": 1.0, "asr": [first, second]}
    df = spark.createDataFrame([("s", json.dumps(meta), 1000.0), ("t", None, 1.0), ("u", "{", 1.0)], "source_id string, metadata string, duration_ms double")
    got = {r["event_id"][2:]: r for r in annotations.events_of(df).collect()}
    assert len(got) == 8
    assert [got[f"ch00/event000{i}"]["faults"] for i in range(7)] == [[], [], [], ["bounds"], ["order"], ["range"], ["segment"]]
    over = got["ch00/event0001"]
    assert over["effective_end_ms"] == 1000.0 and [tuple(x) for x in over["repairs"]] == [(None, 1008.0, 1000.0, 8.0)] and over["activity_fallback_candidate"]
    assert got["ch00/event0003"]["start_ms"] is None and not got["ch00/event0005"]["activity_fallback_candidate"] and got["ch00/event0006"]["effective_end_ms"] == 1000.0
    last = got["ch01/event0000"]
    assert last["faults"] == ["state", "segment"] and last["activity_source"] == "speaker_segments" and not last["activity_fallback_candidate"]
    assert [[round(y, 6) for y in x] for x in last["speaker_segments_ms"]] == [[0.0, 500.0], [0.0, 100.0], [900.0, 1000.0]]
    assert [x["segment_index"] for x in last["repairs"]] == [3]


def test_target_vs_rest(spark):
    cells = spark.createDataFrame([("s", c, k) for c, ks in ((0, [1, 2, 3]), (1, [3, 4]), (2, [3, 9])) for k in ks] + [("t", 0, 5)], "source_id string, channel int, chunk bigint")
    views = spark.createDataFrame([("s0", "s", 0), ("s1", "s", 1), ("s5", "s", 5), ("t0", "t", 0), ("n", "none", 0)], "view_id string, source_id string, channel int")
    assert rows(grid.target_vs_rest(cells, views)) == [("n", 0, 0, 0, 0), ("s0", 3, 3, 1, 2), ("s1", 2, 4, 1, 2), ("s5", 0, 5, 0, 3), ("t0", 1, 0, 0, 0)]


def test_view_contract_finds_planted_faults(spark):
    good = ("g", 3, [True, True, False], [False, True, True], [False, True, False], [0, 1, 2])
    views = [good, ("length", 4, *good[2:]), ("count", 3, good[2], [False, True, False], [False, True, False], good[5]), ("overlap", 3, good[2], good[3], [True, True, False], good[5]), ("null", 3, None, None, None, None)]
    names = "target_active_by_chunk array<boolean>, other_active_by_chunk array<boolean>, overlap_by_chunk array<boolean>, other_active_count_by_chunk array<int>"
    got = {r["view_id"]: r["faults"] for r in checks.view_faults(spark.createDataFrame(views, f"view_id string, chunk_count int, {names}")).collect()}
    assert {k: v for k, v in got.items() if k != "null"} == {"length": ["length"], "count": ["count"], "overlap": ["overlap"]}
