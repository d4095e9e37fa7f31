import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import groups, leakage, nearest, queries, runs, spam, splitting, tokenizer


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- p2


def group(n, state="user_idle", text="x"):
    return f"<|audio_{n}|><|audio_{n}|>{text}<|end_of_sentence|><|{state}|>"


PREFIX = "".join(splitting.PREFIX)
CONTROL = re.compile(splitting.CONTROL)


def length(text):
    return len(CONTROL.sub("x", text))


def split(spark, texts, limit):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "i int, s string, piece_text_ string")
    out = {}
    for r in splitting.split_sequences(df, "s", limit).orderBy("i", "piece_no").collect():
        out.setdefault(r["i"], []).append((r["piece_text"], r["piece"]["first"], r["piece"]["last"], r["piece"]["inside"], r["piece_length"], r["piece"]["start"], r["piece"]["len"]))
    return out


def check_pieces(text, pieces, limit):
    body = text.removeprefix(PREFIX)
    units = re.findall(rf"(?s){splitting.CONTROL}|.", body)
    covered = 0
    for k, (piece, first, last, inside, n, start, size) in enumerate(pieces):
        assert piece.startswith(PREFIX) and length(piece) == n <= limit
        assert piece == PREFIX + "".join(units[start - 1 : start - 1 + size])
        assert start - 1 <= covered < start - 1 + size
        if k and not inside and not pieces[k - 1][3]:
            shared = pieces[k - 1][2] - first
            assert 0 <= shared <= 2
        covered = start - 1 + size
    assert covered == len(units)


def test_split_between_groups_shares_two(spark):
    text = PREFIX + "".join(group(i, text=f"{i:02d}") for i in range(12))  # groups of six units
    pieces = split(spark, [text], 32)[0]  # five groups a piece
    check_pieces(text, pieces, 32)
    assert [(p[1], p[2]) for p in pieces] == [(0, 5), (3, 8), (6, 11), (9, 12)] and not any(p[3] for p in pieces)


def test_split_random(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        parts = [group(i, rng.choice(splitting.STATES), "".join(rng.choice("ab ,的😀\n") for _ in range(rng.choice([0, 1, 3, 8, 60])))) for i in range(rng.randrange(1, 30))]
        texts.append(rng.choice([PREFIX, ""]) + "".join(parts) + rng.choice(["", "tail", "<|noise"]))
    got = split(spark, texts, 40)
    for i, text in enumerate(texts):
        assert (i in got) == (length(text) > 40)
        if i in got:
            check_pieces(text, got[i], 40)
            body = text.removeprefix(PREFIX)
            groups_ = [x for x in re.findall(rf"(?s).*?<\|(?:{'|'.join(splitting.STATES)})\|>|.+$", body)]
            assert any(p[3] for p in got[i]) == (max(map(length, groups_)) + 2 > 40)


def test_split_edges(spark):
    long = PREFIX + group(1, text="字" * 5000)
    got = split(spark, [None, "", "x" * 40, "x" * 41, long, "\u0001" * 100], 40)
    assert sorted(got) == [3, 4, 5] and all(p[3] for p in got[4])
    for i, t in ((3, "x" * 41), (4, long), (5, "\u0001" * 100)):
        check_pieces(t, got[i], 40)
    clash = spark.createDataFrame([("x" * 90, "b", "c", 1)], "s string, shape string, piece string, start int")
    assert splitting.split_sequences(clash, "s", 40).columns == ["s", "shape", "start", "piece_no", "piece", "piece_text", "piece_length"]
    assert splitting.split_sequences(clash, "s", 40).count() == 3


def test_split_is_linear(spark):
    """Twice the length takes about twice the time; a quadratic step would take four times as long."""
    import time

    took = []
    for groups_ in (4_000, 16_000):
        df = spark.createDataFrame([(PREFIX + "".join(group(i % 999, text="abc def") for i in range(groups_)),)], "s string")
        splitting.split_sequences(df, "s").count()
        began = time.perf_counter()
        assert splitting.split_sequences(df, "s").agg(F.max("piece_length")).first()[0] <= 1_500
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1


# --- p3


def test_nearest_random(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), i, rng.choice([None, float("nan")]) if i % 40 == 0 else rng.randrange(0, 40_000) / 4, "c") for i in range(400)]
    points += points[:40] + [(None, 1, 5.0, "c")]
    spans = []
    for i in range(150):
        a = rng.randrange(0, 10_000)
        spans.append((rng.choice("abc"), f"e{rng.randrange(60)}", float(a), float(a + rng.choice([0, 1, 30, 300, 3000])), 1))
    spans += spans[:30] + [("a", None, 1.0, 2.0, 1), ("a", "n", float("nan"), 2.0, 1), ("a", "r", 9.0, 2.0, 1), ("a", "long", 0.0, 2.0**31 + 1, 1), ("b", "longer", 9000.0, 2.0**45, 1), ("b", "far", -(2.0**60), -(2.0**58), 1), ("a", "huge", 2.0**40, 2.0**62, 1)]
    points += [(e, 1000 + k, t, "c") for e in "ab" for k, t in enumerate([2.0**31 + 100, 2.0**31 + 200, 2.0**45 + 1, -(2.0**59), -(2.0**57), 2.0**61 + 7, 1e300, 2.0**33])]
    got = nearest.nearest_intervals(spark.createDataFrame(points, "entity string, point int, at double, item string"), spark.createDataFrame(spans, "entity string, item string, start double, stop double, at int"), 160.0)
    expected = set()
    for e, p, at, _ in points:
        if e is None or at is None or at != at:
            continue
        near = [(max(s - at, at - t, 0.0), s, i) for x, i, s, t, _ in spans if x == e and i and t >= s]
        best = min(near, default=None)
        if best and best[0] <= 160:
            expected.add((e, p, at, best[2], best[0]))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    short = [x for x in spans if x[3] - x[2] < 5000]
    few = nearest.nearest_intervals(spark.createDataFrame(points, "entity string, point int, at double, item string"), spark.createDataFrame(short, "entity string, item string, start double, stop double, at int"), 160.0)
    expected = set()
    for e, p, at, _ in points:
        best = min(((max(s - at, at - t, 0.0), s, i) for x, i, s, t, _ in short if at is not None and at == at and x == e and i and t >= s), default=None)
        if best and best[0] <= 160:
            expected.add((e, p, at, best[2], best[0]))
    assert {tuple(r) for r in few.collect()} == expected


def test_nearest_ties_and_empty(spark):
    p, s = "entity string, point int, at double", "entity string, item string, start double, stop double"
    points = spark.createDataFrame([("a", 1, 100.0)], p)
    spans = spark.createDataFrame([("a", "z", 10.0, 90.0), ("a", "y", 110.0, 120.0), ("a", "x", 10.0, 90.0)], s)
    assert rows(nearest.nearest_intervals(points, spans, 320.0)) == [("a", 1, 100.0, "x", 10.0)]
    assert not rows(nearest.nearest_intervals(points, spark.createDataFrame([], s), 320.0))
    assert not rows(nearest.nearest_intervals(spark.createDataFrame([], p), spans, 320.0))


# --- p4


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(n, root(n)) for n in parent}


def test_components(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    rng.shuffle(chain)
    star = [("hub", f"s{i}") for i in range(80)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    edges = chain + star + loose + [("x", None), ("y", "y"), *star[:9], *[(b, a) for a, b in loose[:9]]]
    got = groups.connected_components(spark.createDataFrame(edges, "u string, v string"))
    assert rows(got) == sorted(brute_components(edges), key=repr)
    assert not rows(groups.connected_components(spark.createDataFrame([], "u string, v string")))


def test_members(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "d"), ("x", "y"), (None, "a")]
    got = groups.linked_members(spark.createDataFrame(edges, "u string, v string"))
    assert rows(got.select("node", "component", "links")) == [("a", "a", 1), ("b", "a", 2), ("c", "a", 1), ("x", "x", 1), ("y", "x", 1)]


def test_split_shares(spark):
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    data = [(f"c{i}", 1 + i % 7) for i in range(6000)] + [(None, 5), ("none", 0)]
    parts = groups.proportional_split(spark.createDataFrame(data, "component string, weight bigint"), shares)
    total = dict(rows(parts.groupBy("split").agg(F.sum("weight"))))
    whole = sum(total.values())
    assert whole == sum(w for c, w in data if c)
    assert total["train"] / whole == pytest.approx(0.8, abs=0.02) and total["test"] / whole == pytest.approx(0.1, abs=0.02)
    # a giant goes to the largest part, and moves no other
    more = groups.proportional_split(spark.createDataFrame([*data, ("giant", 12_000)], "component string, weight bigint"), shares)
    assert dict((r[0], r[2]) for r in more.collect()) == dict((r[0], r[2]) for r in parts.collect()) | {"giant": "train"}


# --- p6


def test_segment_is_optimal():
    from itertools import product

    rng = random.Random(4)

    def cost(codes, cuts, penalty):
        total, edges = 0.0, [0, *cuts, len(codes)]
        for a, b in zip(edges, edges[1:]):
            total += penalty + min(sum(x != v for x in codes[a:b]) for v in set(codes))
        return total

    distance = 1.0 - np.eye(3)
    for _ in range(60):
        codes, penalty = [rng.randrange(3) for _ in range(rng.randrange(1, 9))], rng.choice([0.2, 0.7, 1.4])
        found = runs.segment(codes, [1] * len(codes), distance, penalty)
        ours = sum(penalty + sum(x != v for x in codes[a : b + 1]) for a, b, v in found)
        best = min(cost(codes, [i + 1 for i, c in enumerate(mask) if c], penalty) for mask in product([0, 1], repeat=len(codes) - 1))
        assert ours == pytest.approx(best) and found[0][0] == 0 and found[-1][1] == len(codes) - 1


def test_runs(spark):
    data = [("v", ["user_idle", " USER-IDLE", None, "User Idle", "<|user_idle|>", "user_complete", "huh", "user_idle"]), ("w", []), ("x", None), (None, ["user_idle"] * 2), ("y", [None, None])]
    df = spark.createDataFrame(data + data[:1], "view_id string, states array<string>").withColumn("run_state", F.lit("clash"))
    got = rows(runs.collapse_runs(df, "view_id", "states", queries.CHUNK_STATES, queries.chunk_state).drop("odd_chunks"))
    assert got == sorted([("v", "user_idle", 0, 2, 320), ("v", "user_idle", 3, 2, 320), ("v", "user_complete", 5, 1, 160), ("v", "user_idle", 7, 1, 160), (None, "user_idle", 0, 2, 320)], key=repr)
    near = spark.createDataFrame([("v", ["user_idle"] * 9 + ["user_nonidle"] + ["user_idle"] * 9)], "view_id string, states array<string>")
    assert rows(runs.collapse_runs(near, "view_id", "states", queries.CHUNK_STATES, queries.chunk_state, penalty=1.0)) == [("v", "user_idle", 0, 19, 1, 3040)]


# --- p7

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
def test_tokenizer(spark):
    import tiktoken

    ranks = tokenizer.read_ranks()
    own = tokenizer.Transducer(ranks)
    reference = tiktoken.Encoding("reference", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", " ", "\n\n  x", "I'll it's", "你好，世界", "<|endoftext|>", "a" * 30_000, "好" * 9_000, "ﬁ é 👩‍🏫 𠮷", "​﻿\x00", " " * 500 + "x", "=" * 400]
    for alphabet in ("ab", "the and ", "的一是不了 ", "aA1 -!\n\t", "éüß🙂x"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    for t in texts:
        ids = own.encode(t)
        assert ids == reference.encode_ordinary(t) and own.decode(ids) == t
    assert own.decode([i for i in own.encode("好")][:1]) == "�"
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "x y", "c"), (3, "x y", "c"), (3, "x y", "c")], "doc_id bigint, text string, ids string")
    got = rows(tokenizer.encode_texts(df, "doc_id", "text", check=True))
    xy = reference.encode_ordinary("x y")
    assert got == sorted([(1, [], True), (2, [], True), (None, xy, True), (3, xy, True), (3, xy, True)], key=repr)


@needs_vocabulary
def test_window_stays_small():
    own = tokenizer.Transducer(tokenizer.read_ranks())
    widest = 0
    kept = own.settled

    def watch(start, low):
        nonlocal widest
        widest = max(widest, len(start))
        return kept(start, low)

    own.settled = watch
    assert own.decode(list(own.stream(b"ab" * 20_000 + b"z" * 20_000))) == "ab" * 20_000 + "z" * 20_000
    assert 0 < widest <= 10 * own.reach


# --- p8


def brute_leak(item, doc, window, edits):
    """Least edits of any passage anywhere in the document, by the whole table of prefixes."""
    a, b = leakage.units(item), f" {' '.join(leakage.units(doc))} "
    best = None
    for p in range(len(a) - window + 1):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(f" {' '.join(a[p : p + window])} ", 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        low = min(row)
        if low <= edits and (best is None or low < best):
            best = low
    return best


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks(spark, edits):
    rng = random.Random(edits)
    word = lambda: rng.choice(["alpha", "be", "Gamma", "ｄｅｌｔａ", "我", "们", "好", "42", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 16)))) for i in range(10)] + [(50, None), (51, ""), (None, "a " * 30), (52, "ha " * 40), (53, items_tail := "我 们 " * 9)]
    docs = []
    for d in range(40):
        base = " ".join(word() for _ in range(rng.randrange(0, 14)))
        if d % 3 == 0:
            text = items[rng.randrange(10)][1]
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(["", "z", " ", text[k : k + 1] * 2]) + text[k + rng.randrange(2) :]
            base += " - " + text + "! " + base[:20]
        docs.append((d, base))
    docs += [(100, None), (101, ""), (102, "..."), (None, docs[0][1]), docs[3], (103, "ha ha " * 25), (104, "oh " + items_tail + items_tail)]
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=8, edits=edits)
    expected = set()
    for d, t in docs:
        for i, it in items:
            if d is not None and i is not None and (e := brute_leak(it, t, 8, edits)) is not None:
                expected.add((d, i, e))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected) > 5


def test_leaks_shared_and_repeated(spark):
    """Many items that share a passage, and texts that repeat it, cost no more than the pairs they make."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(60)
    items = [(i, f"{words(5)} {shared} {words(5)}") for i in range(400)]
    docs = [(d, f"{words(20)} {shared} {words(20)}") for d in range(50)] + [(99, " ".join([shared] * 200))]
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert found.count() == 400 * 51
    bounds = leakage.Bounds(24, 0)
    known = np.ones(1 << leakage.BITS, bool)
    assert len(leakage._regions([docs[-1][1]], known, bounds)[0][1][1]) < 3 * len(shared)


def test_leaks_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, "a b c " * 20)], "item_id bigint, text string")
    assert leakage.leaked_items(none, item).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, "a b c " * 20)], "doc_id bigint, text string"), item.filter("item_id > 1")).count() == 0


# --- p9


def test_spam(spark):
    rng = random.Random(8)
    nouns, verbs = ["window", "reader", "garden", "signal", "teacher", "train", "letter", "bridge", "market", "story"], ["opens", "moves", "waits", "sings", "falls", "turns", "writes", "stands"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} near the {rng.choice(nouns)} because we {rng.choice(verbs)} at {rng.randrange(1, 60)} past {rng.choice(nouns)}, and {rng.choice(['nobody', 'everyone', 'somebody'])} was there."
    plain = lambda n: "\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 4))) for _ in range(n))
    words = ["red shoes", "cheap bags", "best hats", "sale", "gloves"]
    stuffed = lambda sep, n: sep.join(rng.choice(words) for _ in range(n))
    links = lambda n: "\n".join(f"[{rng.choice(words)}](http://shop{rng.randrange(99)}.example/x{rng.randrange(9999)})" for _ in range(n))
    docs = {i: plain(rng.randrange(2, 9)) for i in range(300)}
    bad = {1000: stuffed(", ", 90), 1001: links(30), 1002: stuffed(" ", 120), 1003: plain(1) + "\n" + stuffed(" | ", 150), 1004: "\n".join(f"{rng.choice(words)} {rng.choice(words)} ${rng.randrange(900)}" for _ in range(40))}
    good = {2000: plain(8) + "\n" + stuffed(", ", 12), 2001: "", 2002: None, 2003: " \n ", 2004: "\n".join(["A: yes", "B: mm hm", "A: sure"] * 4), 2005: "👩‍🏫"}
    df = spark.createDataFrame(list((docs | bad | good).items()), "doc_id bigint, text string").withColumn("lang", F.lit("xx"))
    assert {r[0] for r in spam.spam_documents(df).select("doc_id").collect()} == set(bad)
    assert spam.spam_documents(df.filter("doc_id < 0")).count() == 0


def test_parts_of_batches():
    import pyarrow as pa

    from turnloom.llm import batches

    texts = ["ab", None, "x" * 50, "", "abc", "defg", "h" * 9, "i"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    got = [b.column(0).to_pylist() for b in batches.parts(batch, (1,), 3, 10)]
    assert got == [[0, 1], [2], [3, 4, 5], [6, 7]] and not list(batches.parts(batch.slice(0, 0), (1,), 3, 10))
    assert [len(b) for b in batches.parts(batch, (1,), 3, 10**6)] == [3, 3, 2]


def test_queries_have_sql_or_tests():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert {f"p{n}_found" for n in (2, 3, 4, 6, 8, 9)} | {"p7_ids"} <= set(queries.QUERIES)
