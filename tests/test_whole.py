"""Jobs done whole: what the reviews found missing."""

import os

import pytest
from oracle import FOLDER
from pyspark.sql import functions as F

from turnloom.functions.ids import clean_id
from turnloom.operators import tokens
from turnloom.plans import pipeline, registry

TOKENS = "array<struct<token_index int, token string, start_ms double, end_ms double, emit_chunk int>>"
EVENTS = "event_id string, source_id string, channel int, final_state string, speaker_segments_ms array<array<double>>, activity_fallback_candidate boolean, effective_event_envelope_ms array<double>"


def test_timelines_hear_recognition_results(spark):
    views = spark.createDataFrame([("s/target-ch00", 20, [True] * 2 + [False] * 18)], "view_id string, chunk_count bigint, target_active_by_chunk array<boolean>")
    events = spark.createDataFrame([
        ("a", "s", 0, "complete", [[0.0, 320.0]], False, None),
        ("b", "s", 0, "incomplete", [], True, [960.0, 1280.0]),  # chunks 6 and 7, a token is near
        ("c", "s", 0, "complete", None, True, [2400.0, 2720.0]),  # chunks 15 and 16, none is
        ("d", "s", 0, "complete", [], False, [2880.0, 3040.0]),  # no candidate
    ], EVENTS)
    # of no length at the border of b's reach, and one near nothing in chunk 12
    results = spark.createDataFrame([("r", "s/target-ch00", [(0, "x", 1440.0, 1440.0, 8), (1, "y", 1920.0, 2080.0, 12), (2, "z", None, 2080.0, 12)])], f"result_id string, view_id string, tokens {TOKENS}")
    lines, lost = pipeline.build_timelines(views, events, results)
    states = lines.first()["chunk_states"]
    assert states[:3] == ["user_nonidle", "user_nonidle", "user_complete"] and states[6:9] == ["user_nonidle", "user_nonidle", "user_incomplete"]
    assert [i for i, s in enumerate(states) if s is None] == [12, 15, 16] and states[18] == "user_idle"
    assert sorted(r[1:] for r in lost.collect()) == [("fallback", 15, 17), ("outside", 12, 13)]
    assert lines.select(F.size("chunk_states")).first()[0] == 20


def test_a_chunk_is_in_the_ranges_of_every_kind(spark):
    views = spark.createDataFrame([("s/target-ch00", 4, [False, True, False, False])], "view_id string, chunk_count bigint, target_active_by_chunk array<boolean>")
    events = spark.createDataFrame([("c", "s", 0, "complete", None, True, [0.0, 640.0])], EVENTS)
    results = spark.createDataFrame([], f"result_id string, view_id string, tokens {TOKENS}")
    lost = pipeline.build_timelines(views, events, results)[1]
    assert sorted(r[1:] for r in lost.collect()) == [("fallback", 0, 4), ("uncovered", 1, 2)]


def _asr(spark, folder, rows):
    spark.createDataFrame(rows, f"result_id string, view_id string, chunk_count bigint, tokens {TOKENS}").write.parquet(f"{folder}/asr_results.parquet")


def test_all_token_faults_come_out(spark, tmp_path):
    one = lambda token, start, end: (0, token, start, end, 0)
    _asr(spark, tmp_path, [
        ("1", "u", 2, [one("a", 160.0, 200.0), one("b", 0.0, 300.0)]),
        ("2", " V\t", 2, [one("a", 0.0, 312.0)]),  # its view lasts 310 ms
        ("3", "w", 2, [one("a", 0.0, 321.0)]),  # 1 ms over two chunks is allowed
        ("4", "x", 2, [one("<|a", 0.0, 322.0)]),
    ])
    spark.createDataFrame([("v", 0.31)], "view_id string, duration_seconds double").write.parquet(f"{tmp_path}/target_views.parquet")
    got = registry.QUERIES["token_contract"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(" V\t", "late", 1), ("u", "disorder", 1), ("x", "control", 1), ("x", "late", 1)]


def test_events_belong_to_the_window_of_their_decision(spark):
    windows = spark.createDataFrame([("v", "w1", 0, 10), ("v", "w2", 10, 20), ("v", "w3", 20, 30)], "view_id string, window_index string, lo int, hi int")
    given = [("a", [[8, 10]], 10), ("b", [[9, 11]], 11), ("c", [[12, 20]], None), ("d", None, 29), (None, [[0, 9]], 9)]
    lines = spark.createDataFrame([("v", given)], "view_id string, event_assignments array<struct<event_id string, activity_chunk_ranges array<array<int>>, decision_chunk int>>")
    got = pipeline.window_events(windows, lines).collect()
    assert sorted(map(tuple, got)) == [("w1", ["a", "b"]), ("w2", ["a", "b", "c"]), ("w3", ["d"])]


def test_fallback_envelopes_are_evidence(spark, tmp_path):
    _asr(spark, tmp_path, [("r", "\tV ", 20, [(0, "a", 0.0, 160.0, 0), (1, "b", 1600.0, 1760.0, 10), (2, "c", 1760.0, 1920.0, 11), (3, "d", None, 5.0, 0)]), ("q", "v", 20, [(0, "e", 640.0, 640.0, 3)])])
    spark.createDataFrame([("v", 20, [True] + [False] * 19)], "view_id string, chunk_count bigint, target_active_by_chunk array<boolean>").write.parquet(f"{tmp_path}/target_views.parquet")
    views, results = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("target_views", "asr_results"))
    envelopes = spark.createDataFrame([("v", "x", 7, 9), ("v", "y", 14, 15), ("w", "z", 0, 20)], "view_id string, event_id string, lo int, hi int")
    heard, pairs = tokens.evidence(results.withColumn("view_id", clean_id(F.col("view_id"))), views, envelopes)
    assert sorted((r["result_id"], r["place"], r["active"]) for r in heard.collect()) == [("q", 0, False), ("r", 0, True), ("r", 1, False), ("r", 2, False)]
    assert sorted((r["result_id"], r["place"], r["event_id"]) for r in pairs.collect()) == [("r", 1, "x")]


def test_export_returns_events_and_what_is_over_the_budget(spark):
    given = [("a", [[0, 1]], 1), ("b", [[1, 2]], 2)]
    row = ("v", "s", 0, ["user_idle", None, "user_idle", "user_idle"], ["ab", "", "x" * 30, ""], [[i, i] for i in range(4)], [False] * 4, [False] * 4, given)
    schema = "view_id string, source_id string, channel int, chunk_states array<string>, chunk_texts array<string>, chunk_audio array<array<int>>, other_active_by_chunk array<boolean>, overlap_by_chunk array<boolean>, event_assignments array<struct<event_id string, activity_chunk_ranges array<array<int>>, decision_chunk int>>"
    lines = spark.createDataFrame([row], schema)
    got = {tuple(r["chunk_range"]): r["event_ids"] for r in pipeline.export_sequences(lines, 30).collect()}
    assert got == {(0, 1): ["a"], (3, 4): []}
    assert [tuple(r) for r in pipeline.oversized_chunks(lines, 30).collect()] == [("v", 2, 36)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_exported_windows_hold_sequences_and_events(spark):
    got = registry.QUERIES["exported_windows"](spark, FOLDER)
    assert {"sequence", "event_ids"} <= set(got.columns)
    assert got.filter("sequence is null or event_ids is null").count() == 0


def test_unreadable_states_are_faults(spark, tmp_path):
    rows = [("a", ["USER-Idle", "<|user_complete|>"]), ("b", ["user_idle", None]), ("c", ["uzer"]), ("d", [])]
    spark.createDataFrame(rows, "view_id string, chunk_states array<string>").write.parquet(f"{tmp_path}/timelines.parquet")
    got = registry.QUERIES["trace_state_faults"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("empty", 1), ("state", 2)]


def test_labels_of_ids_padded_with_tabs_count(spark, tmp_path):
    spark.createDataFrame([("e", None), ("f", None)], "event_id string, official_state string").write.parquet(f"{tmp_path}/final_events.parquet")
    given = [("1", "\tE ", "incomplete", 1), ("2", "f", "complete", 1), ("3", "F\t", "backchannel", 2), ("4", "\t", "wait", 3)]
    spark.createDataFrame(given, "label_id string, event_id string, label_state string, ingested_at int").write.parquet(f"{tmp_path}/state_labels.parquet")
    got = registry.QUERIES["label_origins"](spark, str(tmp_path)).collect()
    assert sorted((r["state"], r["origin"], r["events"]) for r in got) == [("backchannel", "substitute", 1), ("incomplete", "substitute", 1)]
