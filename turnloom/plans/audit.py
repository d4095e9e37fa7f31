"""Queries of contracts, closures, totals and small choices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import formats, hashing
from turnloom.functions.ids import clean_id
from turnloom.operators import annotations, audit, packing
from turnloom.operators.sampling import ordered_places
from turnloom.plans.dialogue import _EV, _SPLIT, _TL, _events, _split_windows, query
from turnloom.session import table


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    names = ("source_id", "view_id", "chunk_range", "chunk_count", "tokenized_length", "event_ids")
    return table(spark, folder, "windows").select("window_index", *names).dropDuplicates(["window_index"])


@query("""with w as (select window_index, any_value(nullif(lower(trim(source_id, chr(9) || ' ')), '')) as source_id, any_value(chunk_count) as chunk_count, any_value(tokenized_length) as n from windows group by 1),
s as (select source_id, any_value(ntrack) as ntrack from sources group by 1)
select coalesce(ntrack, -1) as ntrack, count(*) as windows, sum(chunk_count)::bigint as chunks, max(n) as longest from w left join s using (source_id) group by 1""")
def export_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Exported windows by tracks of their recording: number, chunks and the longest."""
    tracks = table(spark, folder, "sources").groupBy("source_id").agg(F.first("ntrack").alias("ntrack"))
    rows = _windows(spark, folder).withColumn("source_id", clean_id(F.col("source_id"))).join(tracks, "source_id", "left")
    return rows.groupBy(F.coalesce("ntrack", F.lit(-1)).alias("ntrack")).agg(F.count("*").alias("windows"), F.sum("chunk_count").alias("chunks"), F.max("tokenized_length").alias("longest"))


@query(f"with {_SPLIT}, " + r"""q as (select window_index, any_value(sequence) as sequence from model_ready group by 1),
x as (select sp.split, w.source_id, w.window_index, chunk_count, coalesce(len(regexp_extract_all(sequence, '<\|(user_idle|user_nonidle|user_complete|user_incomplete|user_backchannel)\|>')), 0) as states, ids
  from w join sp using (source_id) left join q using (window_index) left join (select window_index, any_value(event_ids) as ids from windows group by 1) using (window_index)),
e as (select split, count(distinct i) as events from (select split, unnest(ids) as i from x) where i in (select nullif(lower(trim(event_id, chr(9) || ' ')), '') from state_labels where event_id is not null) group by 1)
select split, count(*) as windows, count(distinct source_id) as sources, sum(chunk_count)::bigint as chunks, sum(states)::bigint as state_tokens, coalesce(any_value(events), 0) as labelled_events,
  sum(('0x' || sha256(window_index)[1:12])::bigint)::varchar as identity from x left join e using (split) group by split""")
def split_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Each part of the split: windows, recordings, chunks, state tokens, labelled events, and an identity of its windows."""
    parts = _split_windows(spark, folder)
    # counted per row before the join, so that no sequence is shuffled
    states = table(spark, folder, "model_ready").select("window_index", F.coalesce(F.size(packing.state_tokens(F.col("sequence"))), F.lit(0)).alias("states")).dropDuplicates(["window_index"])
    states = states.withColumn("states", F.greatest("states", F.lit(0)))
    rows = parts.join(states, "window_index", "left")
    totals = rows.groupBy("split").agg(
        F.count("*").alias("windows"), F.count_distinct("source_id").alias("sources"), F.sum("chunk_count").alias("chunks"),
        F.coalesce(F.sum("states"), F.lit(0)).cast("bigint").alias("state_tokens"), hashing.set_digest(F.col("window_index")).cast("string").alias("identity"),
    )
    listed = _windows(spark, folder).select("window_index", F.explode("event_ids").alias("event_id"))
    labelled = table(spark, folder, "state_labels").select(clean_id(F.col("event_id")).alias("event_id")).filter("event_id is not null").distinct()
    events = listed.join(labelled, "event_id", "left_semi").join(parts.select("window_index", "split"), "window_index").groupBy("split").agg(F.count_distinct("event_id").alias("labelled_events"))
    return totals.join(events, "split", "left").withColumn("labelled_events", F.coalesce("labelled_events", F.lit(0).cast("bigint")))


@query("""with k as (select event_type, unnest(json_keys(props)) as key, props from events)
select event_type, key, count(*) as calls, round(sum(try_cast(json_extract_string(props, '$.' || key) as double)), 6) as used from k where json_type(props, '$.' || key) in ('BIGINT', 'UBIGINT', 'DOUBLE') group by all""")
def usage_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of every number in a JSON column, by kind and key; truth values and texts are none."""
    rows = table(spark, folder, "events").select("event_type", F.explode(F.expr("map_entries(from_json(props, 'map<string, string>'))")).alias("x"), "props")
    value = F.try_variant_get(F.try_parse_json("props"), "$", "map<string, variant>")[F.col("x.key")]
    rows = rows.withColumn("kind", F.schema_of_variant(value)).filter(F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE)"))
    return rows.groupBy("event_type", F.col("x.key").alias("key")).agg(F.count("*").alias("calls"), F.round(F.sum(F.col("x.value").cast("double")), 6).alias("used"))


@query("""with t as (select view_id, any_value(effective_chunk_count) as chunks, any_value(source_id) as source_id, count(*) as n from timelines group by 1),
a as (select v as view_id, any_value(chunk_count) as chunks, count(*) as n from (select lower(trim(view_id, chr(9) || ' ')) as v, * from asr_results) where v is not null group by 1)
select case when a.view_id is null then 'left' when t.view_id is null then 'right' when t.n > 1 or a.n > 1 then 'repeated' when t.chunks is distinct from a.chunks then 'chunks' end as fault, count(*) as views
from t full join a using (view_id) where fault is not null group by 1""")
def timeline_results(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines joined one to one with recognition results of as many chunks: what stands against it."""
    lines = table(spark, folder, "timelines").select("view_id", F.col("effective_chunk_count").alias("chunks"))
    results = table(spark, folder, "asr_results").select(clean_id(F.col("view_id")).alias("view_id"), F.col("chunk_count").alias("chunks")).filter("view_id is not null")
    return audit.one_to_one(lines, results, "view_id", ["chunks"])[1].groupBy("fault").agg(F.count("*").alias("views"))


@query(f"with {_TL}, " + """c as (select view_id, unnest(states) is null as lost, unnest(coalesce(txt, [])) as t, unnest(range(len(states))) as i from tl where states is not null)
select tl.view_id, len(states)::bigint as size, count(*) filter (not lost and 6 + coalesce(length(t), 0) <= 1500) as exported, count(*) filter (lost or 6 + coalesce(length(t), 0) > 1500) as quarantined, true as closed
from tl left join c using (view_id) where states is not null group by all""")
def chunk_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of a timeline is in an exported window or quarantined, and in one of them only."""
    lines = table(spark, folder, "timelines").select("view_id", "chunk_states", "chunk_asr_targets").dropDuplicates(["view_id"]).filter("chunk_states is not null")
    cost = F.transform("chunk_states", lambda s, i: F.when(s.isNull(), F.lit(10**6)).otherwise(4 + F.coalesce(F.length(F.get("chunk_asr_targets", i)), F.lit(0))))
    lines = lines.withColumn("cost", cost)
    made = lines.select("view_id", F.inline(packing.greedy_windows(F.col("cost"), 1_500, 2)))
    out = lines.select("view_id", F.explode(packing.oversized(F.col("cost"), 1_500, 2)).alias("start")).withColumn("stop", F.col("start") + 1)
    return audit.chunk_closure(lines.select("view_id", F.size("chunk_states").cast("bigint").alias("size")), made, out)


@query(f"with {_EV}, {_TL}, a as (select x.final_state as state, count(*) as n from (select unnest(asg) as x from tl) group by 1), e as (select final_state as state, count(*) as n from ev group by 1)" + """
select state, coalesce(a.n, 0) as found, coalesce(e.n, 0) as expected from a full join e using (state) where coalesce(a.n, 0) <> coalesce(e.n, 0)""")
def expected_totals(spark: SparkSession, folder: str) -> DataFrame:
    """States of the timelines' assignments that are more or fewer than those of the events."""
    lines = table(spark, folder, "timelines").select("view_id", "event_assignments").dropDuplicates(["view_id"]).select(F.explode("event_assignments.final_state").alias("state"))
    found = lines.groupBy("state").agg(F.count("*").alias("n"))
    return audit.total_faults(found, _events(spark, folder, F.col("final_state").alias("state")).groupBy("state").agg(F.count("*").alias("n")), ["state"], "n")


@query("""with e(package, version) as (values ('torch', '2.1.0'), ('numpy', '1.26'), ('scipy', '1.11'), ('pandas', '2.2')), a(package, actual) as (values ('torch', '2.1.0+cu121'), ('numpy', '1.26'), ('pandas', '2.3'))
select package, version, actual from e left join a using (package) where not coalesce(actual = version or package = 'torch' and starts_with(actual, version || '+cu'), false)""")
def package_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Packages that are absent or of another version than the one recorded."""
    expected = spark.createDataFrame([("torch", "2.1.0"), ("numpy", "1.26"), ("scipy", "1.11"), ("pandas", "2.2")], "package string, version string")
    actual = spark.createDataFrame([("torch", "2.1.0+cu121"), ("numpy", "1.26"), ("pandas", "2.3")], "package string, version string")
    return audit.version_drift(expected, actual)


@query("""with d as (select distinct source_id, duration_seconds, recorded_at from sources)
select source_id, case when duration_seconds is null or isnan(duration_seconds) then '—' else printf('%.3f', duration_seconds) end as seconds, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as recorded from d""")
def report_values(spark: SparkSession, folder: str) -> DataFrame:
    """Durations and times of recordings as a report writes them."""
    rows = table(spark, folder, "sources").select("source_id", "duration_seconds", "recorded_at").distinct()
    return rows.select("source_id", formats.fixed(F.col("duration_seconds")).alias("seconds"), formats.utc_stamp(F.col("recorded_at")).alias("recorded"))


@query("""with r as (select result_id, any_value(view_id) as view_id, any_value(source_id) as source_id, any_value(cache_signature) as cache_signature, any_value(chunk_count) as chunk_count from asr_results group by 1),
n as (select *, sha256(concat_ws('|', source_id, chunk_count::varchar)) as new, source_id is null or chunk_count < 1 as bad from r),
c as (select new from n where not coalesce(bad, true) group by 1 having count(distinct coalesce(cache_signature, '')) > 1)
select case when coalesce(bad, true) then 'invalid' when new in (select new from c) then 'clash' else 'kept' end as outcome, count(*) as entries from n group by 1""")
def cache_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Results under a signature of recording and length: kept, refused as invalid, or as sharing it with another content."""
    rows = table(spark, folder, "asr_results").select("result_id", "view_id", "source_id", "cache_signature", "chunk_count").dropDuplicates(["result_id"])
    kept = rows.select("result_id", F.coalesce("cache_signature", F.lit("")).alias("content"), "source_id", "chunk_count")
    new = F.sha2(F.concat_ws("|", "source_id", F.col("chunk_count").cast("string")), 256)
    # entries that are equal under the new signature stay one; here each result counts
    signed = kept.withColumn("key", new)
    good, refused = audit.migrated(signed.select("key", "content", "source_id", "chunk_count"), "key", F.col("key"), F.col("source_id").isNotNull() & (F.col("chunk_count") >= 1))
    n = signed.join(good.select("key"), "key", "left_semi").select(F.lit("kept").alias("outcome")).unionByName(refused.select(F.col("fault").alias("outcome")))
    return n.groupBy("outcome").agg(F.count("*").alias("entries"))


@query(r"""select coalesce(lang, 'none') as lang, count(*) as documents, count(*) filter (regexp_matches(text, '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0E}\x{FE0F}\x{200D}\x{E0020}-\x{E007F}]')) as with_emoji,
  sum(length(regexp_replace(text, '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0E}\x{FE0F}\x{200D}\x{E0020}-\x{E007F}]', '', 'g')))::bigint as characters from documents group by 1""")
def spoken_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as they are to be spoken, without emoji, by language."""
    rows = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "text", formats.without_emoji(F.col("text")).alias("bare"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("text") != F.col("bare")).alias("with_emoji"), F.sum(F.length("bare")).alias("characters"))


@query("""with w as (select window_index, any_value(tokenized_length) as n, any_value(source_id) as source_id from windows where window_index is not null group by 1),
p as (select row_number() over (order by window_index) - 1 as place, window_index, n, source_id from w),
h as (select place, sha256(concat_ws(chr(10), window_index, n::varchar, source_id)) as h from p), r as (select place // 1024 as r, sha256(string_agg(h, '' order by place)) as h from h group by 1)
select sha256(string_agg(h, '' order by r)) as identity from r""")
def inventory_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of the windows as an ordered inventory."""
    rows = table(spark, folder, "windows").filter("window_index is not null").groupBy("window_index").agg(F.first("tokenized_length").alias("size"), F.first("source_id").alias("sha256"))
    return hashing.inventory_identity(ordered_places(rows, "window_index").withColumnRenamed("window_index", "path"))


@query(f"with {_EV}, " + """src as (select source_id, any_value(duration_seconds) * 1000 as d from sources group by 1),
x as (select ev.*, d, isfinite(start_ms) and isfinite(end_ms) as rd from ev join src using (source_id)),
o as (select *, coalesce(last_value(case when rd then start_ms end ignore nulls) over (partition by source_id, channel order by ordinal rows between unbounded preceding and 1 preceding), -1) as prev,
  list_filter(coalesce(segs, []), lambda s: s is not null and len(s) > 0) as sg from x),
f as (select unnest(case when not coalesce(rd, false) then ['bounds'] else list_filter([case when start_ms < prev then 'order' end,
  case when not (start_ms >= 0 and end_ms >= start_ms and start_ms <= d) or end_ms - d > 160 then 'range' end,
  case when raw <> '' and not regexp_full_match(raw, '<\\|(complete|incomplete|backchannel|wait)\\|>') then 'state' end,
  case when len(list_filter(sg, lambda s: not coalesce(isfinite(s[1]) and isfinite(s[2]) and s[1] >= -1 and s[2] >= s[1] and s[1] <= d and s[2] - d <= 160, false))) > 0 then 'segment' end], lambda y: y is not null) end) as fault from o)
select fault, count(*) as events from f group by 1""".replace("\\\\", "\\"))
def extracted_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as annotation documents and read again: by what is wrong with them."""
    segments = F.transform(F.filter(F.coalesce("speaker_segments_ms", F.array().cast("array<array<double>>")), lambda s: F.size(s) > 0), lambda s: F.struct((F.get(s, F.lit(0)) / 1000).alias("startSec"), (F.get(s, F.lit(1)) / 1000).alias("endSec")))
    event = F.struct(
        F.col("start_ms").alias("startInMs"), F.col("end_ms").alias("endInMs"), F.col("lid").alias("LID"), F.col("official_state_raw").alias("state"),
        F.struct(F.col("text").alias("txt")).alias("labels"), F.struct(segments.alias("segments")).alias("speaker"),
    )
    rows = _events(spark, folder, "source_id", "channel", "ordinal", "start_ms", "end_ms", "lid", "official_state_raw", "text", "speaker_segments_ms")
    # a document holds a recording: it is as large as its annotation is, and read as a whole
    tracks = rows.groupBy("source_id", "channel").agg(F.array_sort(F.collect_list(F.struct("ordinal", event.alias("e"))), lambda a, b: a["ordinal"] - b["ordinal"])["e"].alias("track"))
    documents = tracks.groupBy("source_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("channel", "track")), lambda a, b: a["channel"] - b["channel"])["track"].alias("asr"))).alias("metadata"))
    lasting = table(spark, folder, "sources").groupBy("source_id").agg((F.first("duration_seconds") * 1000).alias("duration_ms"))
    found = annotations.events_of(documents.join(lasting, "source_id"))
    return found.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("events"))


@query()
def covering_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Five short sequences that hold all states between them, chosen greedily, with their order."""
    length = F.length(F.regexp_replace("sequence", r"<\|[^<|>]+\|>", "x"))
    rows = table(spark, folder, "model_ready").filter("window_index is not null and sequence is not null").select("window_index", length.alias("n"), "sequence").filter("n between 100 and 1500").dropDuplicates(["window_index"])
    has = {s: F.col("sequence").contains(f"<|{s}|>") for s in packing.STATES}
    chosen = audit.covering_choice(rows, "window_index", "n", has, {s: c for s, c in has.items() if s != "user_idle"}, 5)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(chosen)], "place int, window_index string, n int")
