"""Queries of the problems tagged for language models: p2, p3, p4, p6, p7, p8, p9."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.bounds import valid_pair
from turnloom.functions.ids import clean_id, view_id
from turnloom.llm import groups, leakage, nearest, oracle, runs, spam, splitting, tokenizer
from turnloom.session import table


def _prefixed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "model_ready").select("window_index", "sequence")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized windows, and whether a piece had to be cut inside a group."""
    cut = splitting.cut_points(_prefixed(spark, folder), "sequence").groupBy("window_index")
    return cut.agg(F.when(F.bool_or("piece.inside"), "inside").otherwise("between").alias("cut_at"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of the oversized windows, with the chunks of each.

    Chunks count from the window's chunk_range, or where that is null or the
    window is absent from the range in its index.
    """
    pieces = splitting.split_sequences(_prefixed(spark, folder), "sequence").distinct()
    ranges = table(spark, folder, "windows").select("window_index", F.get("chunk_range", F.lit(0)).alias("from")).groupBy("window_index").agg(F.min("from").alias("from"))
    named = F.regexp_extract("window_index", r"__c(\d+)-\d+$", 1)
    first = F.coalesce("from", F.when(named != "", named.cast("int")))
    return pieces.join(ranges, "window_index", "left").select(
        "window_index", "piece_no", (first + F.col("piece.first")).alias("chunk_start"), (first + F.col("piece.last")).alias("chunk_stop"),
        F.col("piece.inside").alias("cut_inside"), "piece_length", "piece_text",
    )


#: The states of a chunk.
CHUNK_STATES = ["user_backchannel", "user_complete", "user_idle", "user_incomplete", "user_nonidle"]


def chunk_state(raw: object) -> str | None:
    """A state however it is spelled; None for null and for anything else."""
    if raw is None:
        return None
    word = re.sub(r"[\s_-]+", "_", str(raw).strip().removeprefix("<|").removesuffix("|>").strip().lower())
    return word if word in CHUNK_STATES else None


def activity(raw: object) -> str | None:
    return None if raw is None else "active" if raw else "inactive"


def _p6(spark: SparkSession, folder: str, least: int, penalty: float = 0.25) -> DataFrame:
    lines = table(spark, folder, "timelines").withColumn("view_id", clean_id(F.col("view_id")))
    fields = [("chunk_states", CHUNK_STATES, chunk_state), ("target_active_by_chunk", ["active", "inactive"], activity)]
    parts = [runs.collapse_runs(lines, "view_id", name, values, normal, penalty, least=least).withColumn("field", F.lit(name)) for name, values, normal in fields]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p6(spark, folder, 2).select("view_id", "field", "run_state", "start_chunk", "chunk_count")


def p6_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, those of one chunk too, with their duration."""
    return _p6(spark, folder, 1).select("view_id", "field", "run_state", "start_chunk", "chunk_count", "duration_ms")


#: Price of a boundary between near-identical events, in chunks that differ: breaks of up to two chunks within a run are bridged.
NEAR_PENALTY = 1.25


def p6_near(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of near-identical chunks, with how many of them differ from the run's value."""
    return _p6(spark, folder, 1, NEAR_PENALTY).select("view_id", "field", "run_state", "start_chunk", "chunk_count", "odd_chunks", "duration_ms")


#: How far from a token its event may be.
TOLERANCE_MS = 320.0


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """For each recognised token with a time the event spoken nearest to it, and how far off it is."""
    tokens = table(spark, folder, "asr_results").select(clean_id(F.col("view_id")).alias("entity"), F.explode("tokens").alias("t"))
    at = (F.col("t.start_ms") + F.col("t.end_ms")) / 2
    tokens = tokens.select("entity", F.col("t.token_index").alias("point"), at.alias("at"))
    events = table(spark, folder, "final_events")
    entity = view_id(clean_id(F.col("source_id")), F.col("channel")).alias("entity")
    segments = events.select(entity, F.col("event_id").alias("item"), F.explode("speaker_segments_ms").alias("pair"))
    segments = segments.select("entity", "item", valid_pair(F.col("pair")).alias("x")).filter("x is not null")
    found = nearest.nearest_intervals(tokens, segments.select("entity", "item", "x.start", "x.stop"), TOLERANCE_MS)
    return found.toDF("view_id", "token_index", "time_ms", "event_id", "away_ms")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_nearest(spark, folder).select("view_id", "token_index", "event_id").distinct()


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with the recordings that they name."""
    source, view = clean_id(F.col("source_id")), clean_id(F.substring_index(clean_id(F.col("view_id")), "/", 1))
    known = lambda x: F.when(x != "unknown", x)
    return table(spark, folder, "windows").select("window_index", known(source).alias("a"), known(view).alias("b"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ties(spark: SparkSession, folder: str) -> DataFrame:
    return groups.connected_components(_edges(spark, folder))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every tied recording once, with its class and the number of its direct ties: grows with the recordings, not with their pairs."""
    return groups.linked_members(_edges(spark, folder)).withColumnRenamed("node", "source_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    members = _ties(spark, folder)
    a, b = members.select("component", F.col("node").alias("source_a")), members.select("component", F.col("node").alias("source_b"))
    return a.join(b, "component").filter("source_a < source_b").select("source_a", "source_b")


def p4_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every window with its component and part. A window that names no recording is one of its own."""
    windows = _named(spark, folder).select("window_index", F.coalesce("a", "b").alias("node")).distinct()
    tied = windows.join(_ties(spark, folder), "node", "left")
    alone = F.concat(F.lit("window:"), F.coalesce("window_index", F.lit("")))
    tied = tied.select("window_index", F.coalesce("component", "node", alone).alias("component"))
    weights = tied.groupBy("component").agg(F.count("*").alias("weight"))
    parts = groups.proportional_split(weights, {"train": 0.8, "validation": 0.1, "test": 0.1})
    return tied.join(parts.select("component", "split"), "component").select("window_index", "component", "split")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Windows, components and share of each part."""
    parts = p4_split(spark, folder).groupBy("split").agg(F.count("*").alias("windows"), F.countDistinct("component").alias("components"))
    return parts.withColumn("share", F.round(F.col("windows") / F.sum("windows").over(Window.partitionBy(F.lit(0))), 4))


def p7_ids(spark: SparkSession, folder: str, path: str = tokenizer.VOCABULARY) -> DataFrame:
    return tokenizer.encode_texts(table(spark, folder, "documents"), "doc_id", "text", path)


def p7_round_trip(spark: SparkSession, folder: str, path: str = tokenizer.VOCABULARY) -> DataFrame:
    """Per language the documents, their tokens, and how many don't decode to their text."""
    documents = table(spark, folder, "documents")
    coded = tokenizer.encode_texts(documents, "doc_id", "text", path, check=True).withColumn("n", F.size("ids"))
    langs = documents.select("doc_id", "lang").groupBy("doc_id").agg(F.first("lang").alias("lang"))
    return coded.select("doc_id", "n", "same").join(langs, "doc_id").groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if(~F.col("same")).alias("changed")
    )


def _leaks(spark: SparkSession, folder: str, edits: int) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "test_items"), edits=edits)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder, 0).select("doc_id", "item_id")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks of passages with up to two units changed, dropped or added."""
    return _leaks(spark, folder, 2)


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """The leaked items, and in how many documents each occurs."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_documents(table(spark, folder, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of spam lines in every document that has any."""
    return spam.spam_shares(table(spark, folder, "documents")).filter("spam_chars > 0")


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_nearest": p3_nearest,
    "p4_found": p4_found,
    "p4_members": p4_members,
    "p4_split": p4_split,
    "p4_shares": p4_shares,
    "p6_found": p6_found,
    "p6_runs": p6_runs,
    "p6_near": p6_near,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}
ORACLE = oracle.ORACLE
