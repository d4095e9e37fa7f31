import math
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import audit, evaluation, requests
from turnloom.plans.registry import QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 64, 65, 300])
def test_draws_are_those_of_the_generator(size):
    rng, draws = random.Random(size), evaluation.Draws(size)
    expected = [rng.randrange(size) for _ in range(5000)]
    assert [*draws.below(size, 3), *draws.below(size, 4900), *draws.below(size, 97)] == expected


def plain_interval(parts, seed, repetitions):
    rng, means = random.Random(seed), []
    for _ in range(repetitions):
        means.append(sum(sum(p[rng.randrange(len(p))] for _ in p) / len(p) for p in parts) / len(parts))
    means.sort()
    return 100 * means[int(0.025 * repetitions)], 100 * means[int(0.975 * repetitions) - 1]


def test_intervals(spark):
    rng = random.Random(3)
    data = [(f"{lang}", part, f"s{i:03d}", rng.choice([-1, 0, 0, 1])) for lang in ("en", "zh") for part in ("c", "i") for i in range(40)]
    df = spark.createDataFrame(data + [("en", "c", "z", None)], "lang string, part string, sample string, delta int").orderBy(F.rand(1))
    got = {r["lang"]: (r["low_pp"], r["high_pp"]) for r in evaluation.paired_intervals(df, "lang", "part", "sample", "delta", F.lit(4200), 400).collect()}
    for lang in ("en", "zh"):
        parts = [[d for g, p, _, d in data if g == lang and p == part] for part in ("c", "i")]
        assert got[lang] == pytest.approx(plain_interval(parts, 4200, 400))


def test_classes_and_checkpoints(spark):
    data = [(s, "en", "c", i < 8, i < (8 if s == 1 else 4)) for s in (1, 2, 3) for i in range(10)] + [(s, "zh", "c", True, None if s == 9 else True) for s in (1, 2, 3) for _ in range(10)]
    df = spark.createDataFrame(data, "step int, lang string, label string, b boolean, a boolean")
    classes = evaluation.compared_classes(df, ["step", "lang", "label"], F.col("b"), F.col("a"))
    one = classes.filter("step = 2 and lang = 'en'").first()
    assert (one["improved"], one["regressed"], one["unchanged"], one["delta_pp"], one["p_value"]) == (0, 4, 6, -40.0, 0.125)
    steps = evaluation.checkpoint_rows(classes, "step", "lang")
    assert [(r["step"], r["almost_unchanged"], r["decline"], r["confirmed"]) for r in steps.orderBy("step").collect()] == [(1, True, False, False), (2, False, True, True), (3, False, True, False)]
    macros = spark.createDataFrame([(1, -2.0, 99.0), (2, -1.0, 80.0), (3, 0.0, 80.0)], "step int, en_pp double, zh_percent double")
    assert tuple(evaluation.chosen_steps(steps, macros, "step", "en", "zh").first()) == (1, 1, 2, 2)
    assert rows(evaluation.unpaired_samples(spark.createDataFrame([("a",), ("a",), ("b",)], "s string"), spark.createDataFrame([("a",), ("c",)], "s string"), "s")) == [("a", 1), ("b", 1), ("c", -1)]


def test_gate_and_subgroups(spark):
    got = evaluation.gated(spark.createDataFrame([("a", 99, 100), ("b", 90, 100), ("c", 1, 1)], "k string, correct bigint, total bigint"), spark.createDataFrame([("a", 100.0), ("b", 92.0), ("d", 1.0)], "k string, target_percent double"), ["k"])
    assert {r["k"]: r["within"] for r in got.collect()} == {"a": True, "b": False, "c": False, "d": False}
    records = spark.createDataFrame([("x/real/1.wav", "c", True), ("x/real/2.wav", "c", None), ("really/3.wav", "c", True), (None, "c", False)], "path string, label string, ok boolean")
    assert rows(evaluation.subgroup_accuracy(records, "path", "real", F.col("label"), F.col("ok"))) == [("c", "other", 1, 2, 50.0), ("c", "real", 1, 2, 50.0)]


def plain_choice(heads, finals):
    """The rule in its own words, for runs of name -> steps of accuracies."""
    out = []
    for run, steps in heads.items():
        drops = {s: max(steps[min(steps)][h] - a for h, a in accs.items()) for s, accs in steps.items()}
        safe = [s for s in steps if drops[s] <= 0.05]
        out.append((run, drops[max(steps)] <= 0.05 and math.isfinite(finals[run][1]), max(safe), *finals[run]))
    good = sorted((x for x in out if x[1]), key=lambda x: (x[4], x[3]))
    if not good:
        return min(out, key=lambda x: (-x[2], x[3]))[0]
    if len(good) > 1 and abs(good[0][4] - good[1][4]) / min(good[0][4], good[1][4]) <= 0.01:
        return min(good[:2], key=lambda x: x[3])[0]
    return good[0][0]


def test_rate_choice(spark):
    rng = random.Random(5)
    for _ in range(12):
        heads = {r: {s: {h: round(0.9 - (s > 0) * rng.choice([0, 0.02, 0.04, 0.09]), 4) for h in "xyz"} for s in (0, 10, 20)} for r in ("p", "q")}
        finals = {"p": (1e-5, rng.choice([1.0, 1.2, float("nan")])), "q": (2e-5, rng.choice([1.0, 0.995, 0.8]))}
        flat = [(r, s, h, a) for r, steps in heads.items() for s, accs in steps.items() for h, a in accs.items()]
        path = evaluation.guard_trajectory(spark.createDataFrame(flat, "run string, step int, head string, accuracy double"), "run", "step", "head")
        chosen = evaluation.chosen_rate(path, spark.createDataFrame([(r, *x) for r, x in finals.items()], "run string, peak_lr double, objective double"), "run", "step")
        assert [r["run"] for r in chosen.collect()] == [plain_choice(heads, finals)]


def test_heads_and_traces(spark):
    data = spark.createDataFrame([("k", "a", 1.0, 3), ("k", "a", 2.0, 1), ("k", "b", 4.0, 2)], "k string, h string, l double, n int")
    weights = spark.createDataFrame([("a", 0.5)], "head string, weight double")
    assert rows(evaluation.weighted_heads(data, ["k"], "h", "l", "n", weights)) == [("k", 0.625, 2.625, 6)]
    left, right = spark.createDataFrame([(0, "a", None), (1, "b", 5), (3, "c", 1)], "i int, s string, n int"), spark.createDataFrame([(0, "a", None), (1, "b", 6), (2, "c", 1)], "i int, s string, n int")
    assert rows(evaluation.trace_mismatches(left, right, "i", ["s", "n"])) == [(1, "n"), (2, "untraced"), (3, "unlisted")]


def test_requests(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *(float(rng.randrange(3000)) for _ in range(8))]), rng.randrange(4), i) for i in range(120)]
    got = requests.timed_places(spark.createDataFrame(data, "k string, t double, c int, i int"), "k", "t", ["c", "i"], 500.0)
    for key in ("a", "b", None):
        order = sorted((x for x in data if x[0] == key), key=lambda x: (x[1] is None or x[1] != x[1], x[1] if x[1] == x[1] and x[1] is not None else 0.0, x[2], x[3]))
        assert [r["i"] for r in sorted((r for r in got.collect() if r["k"] == key), key=lambda r: r["place"])] == [x[3] for x in order]
    events = spark.createDataFrame([("e1", "s", 0), ("e2", "s", 1)], "event_id string, source_id string, channel int")
    wanted = spark.createDataFrame([("e1", "s"), ("e1", "s"), ("x", "s")], "event_id string, source_id string")
    assert rows(requests.request_faults(events, wanted, spark.createDataFrame([("s", 0)], "source_id string, channel int"))) == [("s", "e1", "repeated"), ("s", "e2", "no view"), ("s", "x", "unknown")]
    sizes = requests.request_sizes(spark.createDataFrame([(f"e{i}", k) for k, n in (("s", 3), ("t", 10), ("u", 99)) for i in range(n)], "event_id string, source_id string"))
    assert [(r["source_id"], r["max_tokens"]) for r in sizes.orderBy("source_id").collect()] == [("s", 1024), ("t", 1600), ("u", 8192)]


def test_relations_of_blocks(spark):
    rng = random.Random(2)
    flags = lambda n: [rng.choice([True, False, None]) for _ in range(n)]
    numbers = lambda n: [rng.choice([0, 1, 2, 3, None]) for _ in range(n)]
    sizes = {"a": 23, "b": 8, "c": 1, "d": 0, "e": 12}
    views = [(k, k, 0, n, flags(n), flags(n), flags(n), numbers(n)) for k, n in sizes.items()]
    views += [(None, "f", 0, 9, flags(9), flags(4), None, [-2] * 9), ("g", "g", 0, None, flags(9), flags(9), flags(9), None), ("a2", "a", 0, 10, flags(10), flags(12), flags(10), numbers(9))]
    bounds = [(0, 1), (0, 160), (159, 161), (639, 641), (640, 1280), (0, 10**6), (1000, 1100), (3000, 3700), (10**15, 2 * 10**15), (0, 3 * 10**11), (2**62, 2**62 + 1)]
    events = [(f"{k}{i}", k, 0, a, b) for k in "abcdefgh" for i, (a, b) in enumerate(bounds) if not (k == "g" and b > 3 * 10**11)]
    events += [(None, "a", 0, 0, 320), ("z", "a", 1, 0, 320)]
    names = ["t", "o", "v", "n"]
    given = spark.createDataFrame(views, "view_id string, source_id string, channel int, chunk_count bigint, t array<boolean>, o array<boolean>, v array<boolean>, n array<int>")
    got = requests.relations(spark.createDataFrame(events, "event_id string, source_id string, channel int, start bigint, stop bigint"), given, names, 4)

    def expected(e, v):
        hi = -(-e[4] // 160) if v[3] is None else min(v[3], -(-e[4] // 160))
        lo = min(e[3] // 160, hi)
        true = lambda x: None if x is None else sum(y is True for y in x[lo:hi])
        return (*e[:3], lo, hi, hi - lo, true(v[4]), true(v[5]), true(v[6]), max((y for y in (v[7] or [])[lo:hi] if y is not None), default=0))

    by_row = lambda x: sorted(x, key=repr)
    assert by_row(map(tuple, got.collect())) == by_row(expected(e, v) for e in events for v in views if e[1:3] == v[1:3])


def test_request_events_of_a_long_view(spark, tmp_path):
    """A view of 400,000 chunks with 20,000 events: with its arrays in each event's row that is 56 GB."""
    folder, size = str(tmp_path), 400_000
    of = lambda each: F.expr(f"transform(sequence(0, {size - 1}), i -> {each})")
    spark.range(1).select(
        F.lit("s/target-ch00").alias("view_id"), F.lit("s").alias("source_id"), F.lit(0).alias("target_channel"), F.lit(size).cast("bigint").alias("chunk_count"), of("i % 2 = 0").alias("target_active_by_chunk"),
        of("i % 5 = 0").alias("other_active_by_chunk"), of("i % 10 = 0").alias("overlap_by_chunk"), of("i % 5").alias("other_active_count_by_chunk"),
    ).write.parquet(f"{folder}/target_views.parquet")
    start = F.col("id") * 3200.0
    spark.range(20_000).select(
        F.format_string("e%05d", "id").alias("event_id"), F.lit("s").alias("source_id"), F.lit(0).alias("channel"), F.lit(0).alias("ordinal"), start.alias("start_ms"),
        F.lit(None).cast("string").alias("official_state"), F.array(start, start + 1600.0).alias("effective_event_envelope_ms"),
    ).write.parquet(f"{folder}/final_events.parquet")
    got = QUERIES["request_events"](spark, folder)
    in_place = (F.col("chunk_start") == F.col("place") * 20) & (F.col("chunk_stop") == F.col("place") * 20 + 10)
    sums = got.groupBy("chunk_span", "target_chunks", "other_chunks", "overlap_chunks", "most_other").agg(F.count_if(in_place), F.countDistinct("place"))
    assert rows(sums) == [(10, 5, 2, 1, 4, 20_000, 20_000)]


def test_responses_and_finalising(spark):
    label = "array<struct<event_id string, state string, confidence double, reason string>>"
    ok = lambda *ids: [(i, "complete", 0.5, "r") for i in ids]
    given = spark.createDataFrame([("1", "m", ok("b", "a")), ("2", "m", ok("c")), ("3", "old", ok("d")), ("4", "m", ok("a")), ("9", "m", ok("z"))], f"signature string, model string, labels {label}")
    asked = spark.createDataFrame([("1", ["a", "b"]), ("2", ["c", "x"]), ("3", ["d"]), ("4", ["a"])], "signature string, event_ids array<string>")
    good, faults = requests.response_rows(given, asked, "m")
    assert [(r["signature"], r["event_id"], r["place"]) for r in good.orderBy("signature", "place").collect()] == [("1", "a", 0), ("1", "b", 1), ("4", "a", 0)]
    assert rows(faults) == [("1", "answered twice"), ("2", "unanswered"), ("3", "model"), ("9", "unknown")]
    events = spark.createDataFrame([("a", "wait"), ("b", None), ("c", "incomplete"), ("d", None), ("e", "odd")], "event_id string, official_state string")
    labels = spark.createDataFrame([("b", "complete"), ("b", "incomplete"), ("c", "huh"), ("q", "complete")], "event_id string, label_state string")
    final, bad = requests.finalised(events, labels)
    assert rows(final)[:4] == [("a", "complete", "wait_as_complete", "mapped"), ("b", "complete", "substitute", "pseudolabel"), ("c", "incomplete", "official", "official"), ("d", None, "none", None)]
    assert rows(bad) == [("b", "duplicate"), ("c", "state"), ("d", "missing"), ("e", "unsupported"), ("q", "unknown")]


def test_contracts_between_stages(spark):
    found, should = spark.createDataFrame([("a", 3), ("b", 2), (None, 1)], "k string, n int"), spark.createDataFrame([("a", 3), ("c", 4)], "k string, n int")
    assert rows(audit.total_faults(found, should, ["k"], "n")) == [("b", 2, 0), ("c", 0, 4), (None, 1, 0)]
    assert audit.tokenizer_faults(lambda t: {"<|a|>": [7], "<|b|>": [1, 2]}[t], {"<|a|>": 7, "<|b|>": 8}) == ["<|b|>"]
    left, right = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 1)], "k string, n int"), spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("d", 1, "x"), ("e", 1, "x")], "k string, n int, v string")
    good, bad = audit.one_to_one(left, right, "k", ["n"])
    assert rows(good) == [("a", 1, "x")] and rows(bad) == [("b", "n"), ("c", "left"), ("d", "repeated"), ("e", "right")]
    lengths = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 10), ("e", 0)], "view_id string, size bigint")
    out = spark.createDataFrame([("a", 0, 4), ("a", 6, 10), ("b", 0, 4), ("c", 0, 6), ("d", 1, 11)], "view_id string, start int, stop int")
    lost = spark.createDataFrame([("a", 4, 6), ("b", 5, 10), ("c", 5, 9)], "view_id string, start int, stop int")
    assert [r["closed"] for r in audit.chunk_closure(lengths, out, lost).orderBy("view_id").collect()] == [True, False, False, False, True]
    slice_ = audit.placed_slice(spark.range(10), "id", 3, 2)
    assert rows(slice_) == [(3,), (4,)]
    with pytest.raises(ValueError):
        audit.placed_slice(spark.range(10), "id", 9, 2)


def test_covering_choice(spark):
    rng = random.Random(7)
    names = "abcd"
    data = [(f"k{i:02d}", rng.randrange(5, 20), "".join(sorted(rng.sample(names, rng.randrange(0, 3))))) for i in range(60)]
    df = spark.createDataFrame(data, "k string, n int, s string")
    has = {x: F.col("s").contains(x) for x in names}
    got = audit.covering_choice(df, "k", "n", has, {x: has[x] for x in "bcd"}, 4)
    left, chosen, covered = [x for x in data if set(x[2]) & set("bcd")], [], set()
    for _ in range(4):
        best = min(left, key=lambda x: (-len(set(x[2]) - covered), x[1], x[0]))
        left.remove(best)
        chosen.append(best[:2])
        covered |= set(best[2])
    assert got == chosen
    with pytest.raises(ValueError):
        audit.covering_choice(df.filter("s not like '%d%'"), "k", "n", has, has, 4)


def test_stream_and_migration(spark):
    rng, stream = random.Random(42), audit.SeededStream(7, 42)
    expected = []
    for _ in range(3):
        order = list(range(7))
        rng.shuffle(order)
        expected += order
    head = [next(stream) for _ in range(10)]
    rest = audit.SeededStream(7, 0, stream.state)
    assert head + [next(rest) for _ in range(11)] == expected and stream.epoch == 1
    kept = spark.createDataFrame([("o1", "a", 1), ("o2", "a", 1), ("o3", "b", 1), ("o4", "b", 2), ("o5", None, 1)], "key string, name string, v int")
    good, refused = audit.migrated(kept, "key", F.concat(F.lit("n-"), "name"), F.col("name").isNotNull())
    assert rows(good) == [("n-a", "a", 1)] and rows(refused.select("key", "fault")) == [("o3", "clash"), ("o4", "clash"), ("o5", "invalid")]
