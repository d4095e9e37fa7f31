import os
import re

import duckdb
import pytest
from oracle import FOLDER, differences
from pyspark.sql import functions as F

from turnloom.llm import leakage, queries, splitting, tokenizer

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE[name]) == ([], [], 0)


def read(name):
    return duckdb.sql(f"select * from '{FOLDER}/{name}.parquet'")


def test_near_leaks_hold_the_exact_ones(spark):
    exact = {tuple(r) for r in queries.p8_found(spark, FOLDER).collect()}
    near = {(r[0], r[1]): r[2] for r in queries.p8_near(spark, FOLDER).collect()}
    assert exact == {k for k, edits in near.items() if edits == 0} and exact


def test_leaks_against_shared_windows(spark):
    """Every document with every item that it has 24 consecutive units in common with, from plain sets of windows."""
    where = {}
    for item, text in read("test_items").select("item_id, text").fetchall():
        us = leakage.units(text)
        for k in range(len(us) - 23):
            where.setdefault(tuple(us[k : k + 24]), set()).add(item)
    expected = set()
    for doc, text in read("documents").select("doc_id, text").fetchall():
        us = leakage.units(text)
        expected |= {(doc, item) for k in range(len(us) - 23) for item in where.get(tuple(us[k : k + 24]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, FOLDER).collect()} == expected
    counted = {}
    for _, item in expected:
        counted[item] = counted.get(item, 0) + 1
    assert {tuple(r) for r in queries.p8_items(spark, FOLDER).collect()} == set(counted.items())


@pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary here")
def test_tokens_of_all_documents(spark):
    import tiktoken

    reference = tiktoken.Encoding("reference", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(), special_tokens={})
    texts = dict(read("documents").select("doc_id, text").fetchall())
    got = {r[0]: list(r[1]) for r in queries.p7_ids(spark, FOLDER).collect()}
    assert got == {d: reference.encode_ordinary(t) if t else [] for d, t in texts.items()}
    trips = queries.p7_round_trip(spark, FOLDER).collect()
    assert sum(r["documents"] for r in trips) == len(texts) and not any(r["changed"] for r in trips)


def test_pieces_of_all_windows(spark):
    """The pieces of each oversized sequence are within the limit and cover its groups in order."""
    found = {}
    for r in queries.p2_pieces(spark, FOLDER).collect():
        found.setdefault(r["window_index"], []).append(r)
    long = {w for w, s in read("model_ready").select("window_index, sequence").fetchall() if s and len(re.sub(splitting.CONTROL, "x", s)) > 1500}
    assert set(found) == long
    for pieces in found.values():
        pieces.sort(key=lambda r: r["piece_no"])
        for r in pieces:
            assert r["piece_text"].startswith("".join(splitting.PREFIX)) and len(re.sub(splitting.CONTROL, "x", r["piece_text"])) == r["piece_length"] <= 1500
        for a, b in zip(pieces, pieces[1:]):
            assert a["chunk_start"] < b["chunk_stop"] and b["chunk_start"] <= a["chunk_stop"] < b["chunk_stop"] + 1


def test_near_runs(spark):
    """Near-identical runs lie one after another, hold the exact runs' chunks, and mix values in few of them."""
    near, exact = queries.p6_near(spark, FOLDER), queries.p6_runs(spark, FOLDER)
    total = lambda df: {tuple(r) for r in df.groupBy("view_id", "field").agg(F.sum("chunk_count").alias("n")).collect()}
    assert total(near) == total(exact) and near.count() < exact.count()
    assert near.filter("odd_chunks * 2 > chunk_count").count() == 0 and near.filter("odd_chunks > 0").count() > 0


def test_spam_by_its_shares(spark):
    shares = {r["doc_id"]: r["spam_share"] for r in queries.p9_shares(spark, FOLDER).collect()}
    found = {r[0] for r in queries.p9_found(spark, FOLDER).collect()}
    assert found == {d for d, x in shares.items() if x > 0.5}
