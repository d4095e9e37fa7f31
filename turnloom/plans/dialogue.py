"""Queries of the timeline engine over the dialogue tables, with their SQL.

Tables hold redelivered rows of equal content; where a query speaks of events,
views or results, each counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import hashing, ids
from turnloom.functions.bounds import chunk_range, valid_pair, valid_pairs
from turnloom.functions.ids import clean_id
from turnloom.operators import cache, checks, contracts, grid, labels, packing, sampling, stats, timeline, tokens
from turnloom.plans import pipeline
from turnloom.session import table


def _events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "final_events").select("event_id", *columns).dropDuplicates(["event_id"])


def _views(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "target_views").select("view_id", *columns).dropDuplicates(["view_id"])


def _segments(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """A row per valid speaker segment of an event."""
    segments = F.explode(valid_pairs(F.col("speaker_segments_ms"))).alias("x")
    return _events(spark, folder, "speaker_segments_ms", *columns).select("event_id", *columns, segments).select("event_id", *columns, "x.start", "x.stop")


def _event_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(view_id, event_id, chunk) of speaker segments."""
    view = ids.view_id(F.col("source_id"), F.col("channel")).alias("view_id")
    segments = _segments(spark, folder, "source_id", "channel").select(view, "event_id", "start", "stop").filter("view_id is not null")
    return grid.chunk_cells(segments, ["view_id", "event_id"])


_EV = "ev as (select event_id, any_value(source_id) as source_id, any_value(channel) as channel, any_value(ordinal) as ordinal, any_value(start_ms) as start_ms, any_value(end_ms) as end_ms, any_value(speaker_segments_ms) as segs, any_value(effective_event_envelope_ms) as env, any_value(official_state) as official_state, any_value(official_state_raw) as raw, any_value(final_state) as final_state, any_value(lid) as lid, any_value(text) as text from final_events group by event_id)"
_SEG = "seg as (select event_id, source_id, channel, round(x[1])::bigint as lo, round(x[2])::bigint as hi from (select event_id, source_id, channel, unnest(segs) as x from ev) where isfinite(x[1]) and isfinite(x[2]) and round(x[2]) > round(x[1]))"
_CELL = "cell as (select distinct source_id, channel, source_id || printf('/target-ch%02d', channel) as view_id, event_id, unnest(range(greatest(lo // 160, 0), greatest((hi + 159) // 160, 0))) as chunk from seg)"
_VIEW = "vw as (select view_id, any_value(source_id) as source_id, any_value(target_channel) as channel, any_value(chunk_count) as chunk_count, any_value(target_active_by_chunk) as ta, any_value(other_active_by_chunk) as oa, any_value(overlap_by_chunk) as ov, any_value(other_active_count_by_chunk) as oc, any_value(conversation_domain) as dom from target_views group by view_id)"
_TL = "tl as (select view_id, any_value(chunk_states) as states, any_value(target_active_by_chunk) as ta, any_value(event_assignments) as asg, any_value(chunk_asr_targets) as txt from timelines group by view_id)"

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL where there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {_EV}, {_SEG}, {_CELL}, {_VIEW}, " + """
c as (select source_id, chunk, list(distinct channel) as tracks from cell group by all),
j as (select v.view_id, c.chunk, list_contains(c.tracks, v.channel) as own, len(c.tracks) - list_contains(c.tracks, v.channel)::int as rest from vw v left join c on c.source_id = v.source_id)
select view_id, count(*) filter (chunk is not null and own) as target_chunks, count(*) filter (chunk is not null and rest > 0) as rest_chunks,
  count(*) filter (chunk is not null and own and rest > 0) as overlap_chunks, coalesce(max(rest) filter (chunk is not null), 0)::int as most_rest from j group by 1""")
def target_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    cells = grid.chunk_cells(_segments(spark, folder, "source_id", "channel"), ["source_id", "channel"])
    views = _views(spark, folder, "source_id", F.col("target_channel").alias("channel"))
    return grid.target_vs_rest(cells, views)


@query(f"with {_EV}, {_VIEW}" + """
select event_id, least(vw.chunk_count, ceil(end_ms / 160.0::double))::bigint as hi, least(floor(start_ms / 160.0::double), least(vw.chunk_count, ceil(end_ms / 160.0::double)))::bigint as lo
from ev join vw on vw.source_id = ev.source_id and vw.channel = ev.channel where isfinite(start_ms) and isfinite(end_ms) and end_ms > start_ms and start_ms >= 0""")
def chunk_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk range of each event on its view's grid."""
    views = _views(spark, folder, "source_id", F.col("target_channel").alias("channel"), "chunk_count")
    events = _events(spark, folder, "source_id", "channel", "start_ms", "end_ms").filter("end_ms > start_ms and start_ms >= 0 and not isnan(end_ms) and end_ms < double('infinity')")
    lo, hi = chunk_range(F.col("start_ms"), F.col("end_ms"), F.col("chunk_count"))
    return events.join(views, ["source_id", "channel"]).select("event_id", lo.alias("lo"), hi.alias("hi"))


@query(f"with {_EV}" + """
select event_id, source_id || printf('/ch%02d/event%04d', channel, ordinal) as rebuilt_id, source_id || printf('/target-ch%02d', channel) as view_id,
  event_id = source_id || printf('/ch%02d/event%04d', channel, ordinal) as same from ev""")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids composed from their parts, held against those stored."""
    rebuilt = ids.event_id(F.col("source_id"), F.col("channel"), F.col("ordinal"))
    events = _events(spark, folder, "source_id", "channel", "ordinal")
    return events.select("event_id", rebuilt.alias("rebuilt_id"), ids.view_id(F.col("source_id"), F.col("channel")).alias("view_id"), (F.col("event_id") == rebuilt).alias("same"))


@query(f"with {_EV}, {_SEG}, {_CELL} select view_id, count(distinct chunk) as active_chunks, min(chunk) as first_chunk, max(chunk) as last_chunk from cell where view_id is not null group by 1")
def activity_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Active chunks of each view: interval-to-cell explosion and OR."""
    cells = _event_cells(spark, folder).groupBy("view_id", "chunk").agg(F.count("*").alias("events"))
    return cells.groupBy("view_id").agg(F.count("*").alias("active_chunks"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))


@query(f"with {_EV} select coalesce(nullif(official_state, ''), 'missing') as state, count(*) as events, count(*) filter (text is null or trim(text) = '') as blank_texts from ev group by 1")
def state_distribution(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder, "official_state", "text")
    state = F.when(F.coalesce("official_state", F.lit("")) == "", "missing").otherwise(F.col("official_state"))
    return events.groupBy(state.alias("state")).agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank_texts"))


@query(f"with {_EV}" + r"""
select coalesce(case when regexp_extract(raw, '^<\|([a-z]+)\|>$', 1) in ('complete','incomplete','backchannel','wait') then regexp_extract(raw, '^<\|([a-z]+)\|>$', 1) end, 'none') as state,
  coalesce(raw <> '' and not (regexp_extract(raw, '^<\|([a-z]+)\|>$', 1) in ('complete','incomplete','backchannel','wait')), false) as is_error, count(*) as events from ev group by all""")
def raw_states(spark: SparkSession, folder: str) -> DataFrame:
    """Raw states read, and those that are errors."""
    state, wrong = labels.read_state(F.col("official_state_raw"))
    return _events(spark, folder, "official_state_raw").groupBy(F.coalesce(state, F.lit("none")).alias("state"), wrong.alias("is_error")).agg(F.count("*").alias("events"))


_LATEST = """lab as (select event_id, label_state from (select lower(trim(event_id, chr(9) || ' ')) as event_id, label_state, row_number() over (partition by lower(trim(event_id, chr(9) || ' ')) order by ingested_at desc, label_id desc) as n from state_labels where event_id is not null) where n = 1)"""


@query(f"with {_EV}, {_LATEST}, " + """
m as (select case when official_state = 'wait' then 'complete' when official_state is not null then official_state else label_state end as state,
  case when official_state = 'wait' then 'wait_as_complete' when official_state is not null then 'official' when label_state is not null then 'substitute' else 'none' end as origin
  from ev left join lab using (event_id))
select state, origin, count(*) as events from m group by all""")
def label_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """State of each event by precedence of sources, counted."""
    given = table(spark, folder, "state_labels").select(clean_id(F.col("event_id")).alias("event_id"), "label_state", "ingested_at", "label_id").filter("event_id is not null")
    last = labels.latest(given, "event_id", ["label_state"], ["ingested_at", "label_id"])
    state, origin = labels.precedence(F.col("official_state"), F.col("label_state"))
    return _events(spark, folder, "official_state").join(last, "event_id", "left").groupBy(state.alias("state"), origin.alias("origin")).agg(F.count("*").alias("events"))


@query(f"with {_EV}, o as (select *, lag(start_ms) over (partition by source_id, channel order by ordinal, start_ms) as previous from ev where start_ms is not null) select event_id, start_ms, previous from o where start_ms < previous")
def monotone_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Events that start before the one before them on their track."""
    events = _events(spark, folder, "source_id", "channel", "ordinal", "start_ms")
    return checks.order_violations(events, ["source_id", "channel"], ["ordinal"], "start_ms").select("event_id", "start_ms", "previous")


@query(f"with {_TL}, " + """
c as (select view_id, unnest(ta) as a, unnest(range(len(ta))) as i from tl), k as (select view_id, i, i - row_number() over (partition by view_id order by i) as g from c where a)
select view_id, min(i)::int as start_chunk, (max(i) + 1)::int as stop_chunk from k group by view_id, g""")
def activity_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Contiguous active ranges of each view's flags, from the row's own array."""
    lines = table(spark, folder, "timelines").select("view_id", "target_active_by_chunk").dropDuplicates(["view_id"])
    return lines.select("view_id", F.inline(grid.true_ranges(F.col("target_active_by_chunk")))).toDF("view_id", "start_chunk", "stop_chunk")


@query(f"with {_TL}, " + """
c as (select view_id, unnest(states) as s, unnest(range(len(states))) as i from tl), k as (select view_id, i, i - row_number() over (partition by view_id order by i) as g from c where s is not null)
select view_id, min(i)::int as start_chunk, (max(i) + 1)::int as stop_chunk from k group by view_id, g""")
def usable_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of chunks that aren't quarantined."""
    lines = table(spark, folder, "timelines").select("view_id", "chunk_states").dropDuplicates(["view_id"])
    flags = F.transform("chunk_states", lambda s: s.isNotNull())
    return lines.select("view_id", F.inline(grid.true_ranges(flags))).toDF("view_id", "start_chunk", "stop_chunk")


@query(f"with {_EV}, {_SEG}, {_CELL} select view_id, event_id, max(chunk) + 1 as decision_chunk, count(*) as active_chunks from cell where view_id is not null group by all")
def decision_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.decision_chunks(_event_cells(spark, folder), ["view_id", "event_id"])


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    states = _events(spark, folder, F.col("final_state").alias("state"))
    return timeline.claims(_event_cells(spark, folder), states)


_CLAIM = """st as (select event_id, case when final_state in ('complete','incomplete','wait') then 'user_nonidle' when final_state = 'backchannel' then 'user_backchannel' end as act,
  case when final_state in ('complete','wait') then 'user_complete' when final_state = 'incomplete' then 'user_incomplete' end as term from ev),
cl as (select c.view_id, c.chunk, event_id, 'activity' as kind, act as state from cell c join st using (event_id) where act is not null and c.view_id is not null
  union all select c.view_id, max(c.chunk) + 1, event_id, 'terminal', term from cell c join st using (event_id) where term is not null and c.view_id is not null group by c.view_id, event_id, term)"""


@query(f"with {_EV}, {_SEG}, {_CELL}, {_CLAIM}, x as (select view_id, chunk, count(distinct state) as states, count(distinct event_id) as events from cl group by all) select view_id, count(*) as claimed_chunks, count(*) filter (states > 1) as conflict_chunks, sum(events)::bigint as claimants from x group by 1")
def claim_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each view that are claimed, and by several states."""
    each = _claims(spark, folder).groupBy("view_id", "chunk", "event_id").agg(F.min("state").alias("lo"), F.max("state").alias("hi"))
    by_chunk = each.groupBy("view_id", "chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("events"))
    return by_chunk.groupBy("view_id").agg(F.count("*").alias("claimed_chunks"), F.count_if(F.col("lo") != F.col("hi")).alias("conflict_chunks"), F.sum("events").alias("claimants"))


@query(f"with {_EV}, {_VIEW} " + """
select event_id, (hi - lo)::int as chunk_span, len(list_filter(ta[lo + 1:hi], lambda x: x))::int as target_chunks, len(list_filter(oa[lo + 1:hi], lambda x: x))::int as other_chunks,
  len(list_filter(ov[lo + 1:hi], lambda x: x))::int as overlap_chunks, coalesce(list_max(oc[lo + 1:hi]), 0)::int as most_other
from (select event_id, ta, oa, ov, oc, least(round(env[1])::bigint // 160, least(chunk_count, (round(env[2])::bigint + 159) // 160)) as lo, least(chunk_count, (round(env[2])::bigint + 159) // 160) as hi
  from ev join vw on vw.source_id = ev.source_id and vw.channel = ev.channel where isfinite(env[1]) and isfinite(env[2]) and round(env[2]) > round(env[1]) and env[1] >= 0)""")
def relation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What the envelope of each event covers of its view."""
    names = ["target_active_by_chunk", "other_active_by_chunk", "overlap_by_chunk", "other_active_count_by_chunk"]
    views = _views(spark, folder, "source_id", F.col("target_channel").alias("channel"), "chunk_count", *names)
    events = _events(spark, folder, "source_id", "channel", valid_pair(F.col("effective_event_envelope_ms")).alias("x")).filter("x is not null and x.start >= 0")
    lo, hi = chunk_range(F.col("x.start").cast("double"), F.col("x.stop").cast("double"), F.col("chunk_count"))
    joined = events.join(views, ["source_id", "channel"]).withColumn("lo", lo).withColumn("hi", hi)
    return joined.select("event_id", *grid.slice_sums(F.col("lo"), F.col("hi"), *[F.col(n) for n in names]))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "asr_results").select("result_id", clean_id(F.col("view_id")).alias("view_id"), "chunk_count", "tokens").dropDuplicates(["result_id"])
    return rows.select("result_id", "view_id", "chunk_count", F.explode("tokens").alias("t")).select("result_id", "view_id", "chunk_count", "t.*")


_TOK = "tok as (select result_id, lower(trim(view_id, chr(9) || ' ')) as view_id, chunk_count, t.* from (select result_id, view_id, chunk_count, unnest(tokens) as t from (select result_id, any_value(view_id) as view_id, any_value(chunk_count) as chunk_count, any_value(tokens) as tokens from asr_results group by result_id)))"


@query(f"with {_TOK} select greatest(0, least(chunk_count - 1, ceil(end_ms / 160.0::double) - 1))::int as emitted, count(*) as tokens, count(*) filter (emit_chunk = greatest(0, least(chunk_count - 1, ceil(end_ms / 160.0::double) - 1))) as as_stored from tok where isfinite(end_ms) group by 1")
def emit_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens by the chunk that they are emitted in."""
    chunk = tokens.emit_chunk(F.col("end_ms"), F.col("chunk_count"))
    timed = _tokens(spark, folder).filter("end_ms is not null and not isnan(end_ms)").withColumn("emitted", chunk)
    return timed.groupBy("emitted").agg(F.count("*").alias("tokens"), F.count_if(F.col("emit_chunk") == F.col("emitted")).alias("as_stored"))


@query("""select view_id, fault, count(*) as results from (select view_id, unnest(list_filter([
  case when len(list_filter(tokens, lambda t: t.start_ms is null or t.end_ms is null or not isfinite(t.start_ms) or not isfinite(t.end_ms))) > 0 then 'untimed' end,
  case when len(list_filter(tokens, lambda t: t.end_ms < t.start_ms)) > 0 then 'reversed' end,
  case when len(list_filter(range(1, len(tokens)), lambda i: tokens[i + 1].start_ms < tokens[i].start_ms or tokens[i + 1].end_ms < tokens[i].end_ms)) > 0 then 'disorder' end,
  case when len(list_filter(tokens, lambda t: t.end_ms > coalesce(seconds * 1000, chunk_count * 160.0::double) + 1)) > 0 then 'late' end,
  case when len(list_filter(tokens, lambda t: contains(t.token, '<|') or contains(t.token, '|>'))) > 0 then 'control' end], lambda x: x is not null)) as fault
  from (select result_id, any_value(coalesce(view_id, '')) as view_id, any_value(lower(trim(view_id, chr(9) || ' '))) as k, any_value(chunk_count) as chunk_count, any_value(tokens) as tokens from asr_results group by 1) r
  left join (select view_id as k, any_value(duration_seconds) as seconds from target_views group by 1) v using (k)) group by all""")
def token_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Results by view and each of the five faults of their tokens; a recording lasts as its view says, else its chunks."""
    rows = table(spark, folder, "asr_results").select("result_id", clean_id(F.col("view_id")).alias("k"), F.coalesce("view_id", F.lit("")).alias("view_id"), "chunk_count", "tokens").dropDuplicates(["result_id"])
    lasting = _views(spark, folder, "duration_seconds").select(F.col("view_id").alias("k"), "duration_seconds")
    duration = F.coalesce(F.col("duration_seconds") * 1000, F.col("chunk_count") * 160.0)
    faults = rows.join(lasting, "k", "left").select("view_id", F.explode(tokens.token_faults(F.col("tokens"), duration)).alias("fault"))
    return faults.groupBy("view_id", "fault").agg(F.count("*").alias("results"))


@query(f"with {_TOK}, " + r"""
p as (select result_id, emit_chunk, token_index, token, lag(regexp_matches(token, '[A-Za-z0-9]') and not regexp_matches(token, '[\x{4e00}-\x{9fff}]')) over (partition by result_id, emit_chunk order by token_index, token) as prev
  from tok where length(token) > 0)
select result_id, emit_chunk, string_agg(case when prev then ' ' || token else token end, '' order by token_index, token) as text, count(*) as tokens from p group by all""")
def rendered_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each chunk of a result."""
    return tokens.render_groups(_tokens(spark, folder), ["result_id", "emit_chunk"], "token_index", "token")


@query(f"with {_TL}, " + """
w as (select window_index, view_id, chunk_range[1] as lo, chunk_range[2] as hi from (select window_index, any_value(lower(trim(view_id, chr(9) || ' '))) as view_id, any_value(chunk_range) as chunk_range from windows group by 1)),
e as (select view_id, unnest(asg) as e from tl),
a as (select view_id, e.event_id as event_id, unnest(e.activity_chunk_ranges) as r from e),
m as (select window_index, event_id from w join a on a.view_id = w.view_id and a.r[1] < w.hi and a.r[2] > w.lo and a.r[1] < a.r[2] and w.lo < w.hi
  union select window_index, e.event_id from w join e on e.view_id = w.view_id and e.decision_chunk >= w.lo and e.decision_chunk < w.hi)
select window_index, list_sort(list(distinct event_id)) as event_ids from m where event_id is not null group by 1""")
def window_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each window: their activity overlaps its chunks, or their decision is in one of them."""
    windows = table(spark, folder, "windows").select("window_index", "view_id", "chunk_range").dropDuplicates(["window_index"])
    windows = windows.select(clean_id(F.col("view_id")).alias("view_id"), "window_index", F.get("chunk_range", F.lit(0)).alias("lo"), F.get("chunk_range", F.lit(1)).alias("hi"))
    return pipeline.window_events(windows, table(spark, folder, "timelines").select("view_id", "event_assignments").dropDuplicates(["view_id"]))


_PACKED = """, c as materialized (select view_id, u.i as i, case when u.s is null then 1000000 else 4 + coalesce(length(u.t), 0) end as c from (select view_id, unnest(list_transform(range(1, len(states) + 1), lambda i: {'i': i, 's': states[i], 't': txt[i]})) as u from tl)),
p(view_id, i, w, cost, skip) as (
  select view_id, i, 0, case when 2 + c > 1500 then 2 else 2 + c end, 2 + c > 1500 from c where i = 1
  union all
  select c.view_id, c.i, case when 2 + c.c > 1500 or p.skip or p.cost + c.c > 1500 then p.w + 1 else p.w end,
    case when 2 + c.c > 1500 then 2 when p.skip or p.cost + c.c > 1500 then 2 + c.c else p.cost + c.c end, 2 + c.c > 1500
  from p join c on c.view_id = p.view_id and c.i = p.i + 1)"""


@query(f"with recursive {_TL}{_PACKED} select view_id, (min(i) - 1)::int as start_chunk, max(i)::int as stop_chunk, max(cost)::double as cost from p where not skip group by view_id, w")
def packed_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk groups of each view packed into windows of at most 1,500: two audio tokens, text, end and state a chunk.

    Quarantined chunks are over any budget, so they end a window and are left out.
    """
    lines = table(spark, folder, "timelines").select("view_id", "chunk_states", "chunk_asr_targets").dropDuplicates(["view_id"])
    cost = F.zip_with("chunk_states", "chunk_asr_targets", lambda s, t: F.when(s.isNull(), F.lit(10**6)).otherwise(4 + F.coalesce(F.length(t), F.lit(0))))
    return lines.select("view_id", F.inline(packing.greedy_windows(cost, 1_500, 2))).toDF("view_id", "start_chunk", "stop_chunk", "cost")


@query("""with l as (select l_orderkey, l_quantity as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as i from lineitem),
recursive_ as (select 1) select * from (
with recursive p(k, i, w, cost, skip) as (
  select l_orderkey, i, 0, case when q > 40 then 0 else q end, q > 40 from l where i = 1
  union all
  select l.l_orderkey, l.i, case when l.q > 40 then p.w + 1 when p.skip then p.w + 1 when p.cost + l.q > 40 then p.w + 1 else p.w end,
    case when l.q > 40 then 0 when p.skip or p.cost + l.q > 40 then l.q else p.cost + l.q end, l.q > 40
  from p join l on l.l_orderkey = p.k and l.i = p.i + 1)
select k as l_orderkey, (min(i) - 1)::int as start, max(i)::int as stop, max(cost) as cost from p where not skip group by k, w)""")
def packed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each order packed under a budget of 40; lines over it alone are left out."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line))["l_quantity"].alias("costs"))
    return orders.select("l_orderkey", F.inline(packing.greedy_windows(F.col("costs"), 40)))


@query(r"""with s as (select distinct window_index, sequence from model_ready where sequence is not null)
select u as state, count(*) as groups, count(distinct window_index) as windows from (select window_index, unnest(regexp_extract_all(sequence, '<\|(user_idle|user_nonidle|user_complete|user_incomplete|user_backchannel)\|>', 1)) as u from s) group by 1""")
def state_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """States that end the groups of the sequences: counted per sequence first, so little is shuffled."""
    rows = table(spark, folder, "model_ready").select("window_index", F.sha2("sequence", 256).alias("h"), packing.state_tokens(F.col("sequence")).alias("all"))
    times = lambda state: F.size(F.filter("all", lambda x: x == state))
    counted = F.array(*[F.struct(F.lit(s).alias("state"), times(s).alias("n")) for s in packing.STATES])
    per = rows.select("window_index", "h", F.inline(counted)).filter("n > 0").distinct()
    return per.groupBy("state").agg(F.sum("n").alias("groups"), F.count_distinct("window_index").alias("windows"))


@query(r"""select regexp_full_match(sequence, '<\|task_duplex_predict\|><\|punctuation_off\|>(<\|audio_[0-9]+\|><\|audio_[0-9]+\|>[^<|>]*<\|end_of_sentence\|><\|(user_idle|user_nonidle|user_complete|user_incomplete|user_backchannel)\|>)+') as valid, count(*) as rows from model_ready group by 1""")
def sequence_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that follow the grammar as a whole."""
    return table(spark, folder, "model_ready").groupBy(packing.is_sequence(F.col("sequence")).alias("valid")).agg(F.count("*").alias("rows"))


@query("""select 'left' as side, count(*) as keys from (select distinct window_index from windows where window_index is not null except select window_index from model_ready)
union all select 'right', count(*) from (select distinct window_index from model_ready where window_index is not null except select window_index from windows)
union all select 'both', count(*) from (select window_index from windows where window_index is not null intersect select window_index from model_ready)""")
def closure_check(spark: SparkSession, folder: str) -> DataFrame:
    """Windows without a sequence, the reverse, and what both have."""
    windows, ready = (table(spark, folder, n).select("window_index") for n in ("windows", "model_ready"))
    only = checks.key_differences(windows, ready, "window_index")
    both = windows.distinct().join(ready, "window_index", "left_semi").select("window_index", F.lit("both").alias("side"))
    sides = spark.createDataFrame([("left",), ("right",), ("both",)], "side string")
    counted = only.unionByName(both).groupBy("side").agg(F.count("*").alias("n"))
    return sides.join(counted, "side", "left").select("side", F.coalesce("n", F.lit(0).cast("bigint")).alias("keys"))


@query("select window_index, count(*) as rows from windows group by 1 having count(*) > 1")
def redelivered_windows(spark: SparkSession, folder: str) -> DataFrame:
    return checks.repeated_keys(table(spark, folder, "windows"), ["window_index"])


@query(f"with {_VIEW}, " + """f as (select view_id, unnest(list_filter([
  case when len(ta) <> chunk_count or len(oa) <> chunk_count or len(ov) <> chunk_count or len(oc) <> chunk_count then 'length' end,
  case when list_bool_or(list_transform(list_zip(oa, oc), lambda z: z[1] <> (z[2] > 0))) then 'count' end,
  case when list_bool_or(list_transform(list_zip(ta, oa, ov), lambda z: (z[1] and z[2]) <> z[3])) then 'overlap' end], lambda x: x is not null)) as fault from vw)
select fault, count(*) as views from f group by 1""")
def view_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Views whose arrays disagree with each other."""
    faults = checks.view_faults(table(spark, folder, "target_views").dropDuplicates(["view_id"])).select("view_id", F.explode("faults").alias("fault"))
    return faults.groupBy("fault").agg(F.count("*").alias("views"))


@query(f"with {_VIEW}, {_EV}, " + """
listed as (select unnest(ids) as event_id from (select view_id, any_value(target_event_ids) as ids from target_views group by 1)),
n as (select event_id, sum(s)::bigint as surplus from (select event_id, 1 as s from listed union all select event_id, -1 from ev) group by 1)
select surplus, count(*) as events from n where surplus <> 0 group by 1""")
def event_bag_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Events that views list more or less often than they exist."""
    listed = _views(spark, folder, "target_event_ids").select(F.explode("target_event_ids").alias("event_id"))
    bag = checks.bag_differences(listed, _events(spark, folder), ["event_id"])
    return bag.groupBy("surplus").agg(F.count("*").alias("events"))


@query(f"with {_EV}, r as (select event_id, official_state, row_number() over (partition by official_state order by sha256(event_id), event_id) as place from ev where official_state is not null) select event_id, official_state, place::int as place from r where place between 3 and 7")
def calibration_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five events of each state by hash order, after the first two."""
    events = _events(spark, folder, "official_state").filter("official_state is not null")
    return sampling.hashed_top(events, "official_state", "event_id", 5, 2)


def _split_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = table(spark, folder, "windows").select("window_index", clean_id(F.col("source_id")).alias("source_id"), "chunk_count").dropDuplicates(["window_index"])
    return windows.join(sampling.group_split(windows, "source_id", 0.05), "source_id")


_SPLIT = """w as (select window_index, any_value(nullif(lower(trim(source_id, chr(9) || ' ')), '')) as source_id, any_value(chunk_count) as chunk_count from windows group by 1),
k as (select source_id, row_number() over (order by sha256('42:' || source_id), source_id) as place, count(*) over () as total from (select distinct source_id from w where source_id is not null)),
sp as (select source_id, case when place <= least(greatest(round_even(total * 0.05, 0)::bigint, 1), total - 1) then 'validation' else 'train' end as split from k)"""


@query(f"with {_SPLIT} select source_id, split from sp")
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings held out by hash order."""
    windows = table(spark, folder, "windows").select(clean_id(F.col("source_id")).alias("source_id"))
    return sampling.group_split(windows, "source_id", 0.05)


@query(f"with {_SPLIT} select split, count(*) as windows, count(distinct source_id) as sources, sum(chunk_count)::bigint as chunks, round(sum(chunk_count) * 0.16::double / 3600, 6) as hours from w join sp using (source_id) group by 1")
def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_windows(spark, folder).groupBy("split")
    return rows.agg(F.count("*").alias("windows"), F.count_distinct("source_id").alias("sources"), F.sum("chunk_count").alias("chunks"), F.round(F.sum("chunk_count") * 0.16 / 3600, 6).alias("hours"))


@query(f"with {_SPLIT}, j as (select source_id, count(distinct split) as splits from w join sp using (source_id) group by 1) select count(*) filter (splits > 1) as leaked_sources from j")
def leakage_check(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings in more than one part of the split: none."""
    return sampling.shared_keys(_split_windows(spark, folder), "source_id", "split").agg(F.count("*").alias("leaked_sources"))


@query("select sha256('[\"' || array_to_string(list_sort(list(distinct view_id)), '\",\"') || '\"]') as identity, source_id from target_views group by source_id")
def view_list_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Identity of each recording's views: as many as it has tracks."""
    return table(spark, folder, "target_views").groupBy("source_id").agg(hashing.list_identity(F.collect_set("view_id")).alias("identity"))


@query("select coalesce(official_state, '') as official_state, sum(('0x' || sha256(event_id)[1:12])::bigint)::varchar as digest from (select distinct event_id, official_state from final_events) group by 1")
def event_set_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Order-free identity of the events of each state."""
    events = table(spark, folder, "final_events").select("event_id", F.coalesce("official_state", F.lit("")).alias("official_state")).distinct()
    return events.groupBy("official_state").agg(hashing.set_digest(F.col("event_id")).cast("string").alias("digest"))


@query("""select label_id, sha256('{"confidence":' || coalesce(confidence::varchar, 'null') || ',"event_id":' || coalesce('"' || replace(event_id, chr(9), chr(92) || 't') || '"', 'null') || ',"state":' || coalesce('"' || label_state || '"', 'null') || '}') as signature
from (select label_id, any_value(confidence) as confidence, any_value(event_id) as event_id, any_value(label_state) as label_state from state_labels group by 1)""")
def label_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signature of each label's content."""
    rows = table(spark, folder, "state_labels").select("label_id", "event_id", "label_state", "confidence").dropDuplicates(["label_id"])
    return rows.select("label_id", hashing.signature(event_id=F.col("event_id"), state=F.col("label_state"), confidence=F.col("confidence")).alias("signature"))


@query(f"with {_EV} " + """select l.label_profile, lower(ev.lid) as lid, count(*) filter (l.label_state = ev.final_state) as correct, count(*) as total, count(*) filter (l.label_state = ev.final_state) / count(*)::double as accuracy
from (select label_id, any_value(lower(trim(event_id, chr(9) || ' '))) as event_id, any_value(label_state) as label_state, any_value(label_profile) as label_profile from state_labels group by 1) l join ev using (event_id) group by all""")
def label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of labels with the final state by judge and language."""
    return stats.accuracy(_judged(spark, folder), ["label_profile", "lid"], F.col("label_state") == F.col("final_state"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "state_labels").select("label_id", clean_id(F.col("event_id")).alias("event_id"), "label_state", "label_profile").dropDuplicates(["label_id"])
    return given.join(_events(spark, folder, "final_state", F.lower("lid").alias("lid")), "event_id")


@query(f"with a as ({ORACLE['label_accuracy']}) select label_profile, avg(accuracy) as macro_accuracy, count(*) as classes from a group by 1")
def macro_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return stats.macro(label_accuracy(spark, folder), ["label_profile"])


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Events judged right or wrong twice: by the official state, and by the latest label."""
    given = table(spark, folder, "state_labels").select(clean_id(F.col("event_id")).alias("event_id"), "label_state", "ingested_at", "label_id")
    last = labels.latest(given, "event_id", ["label_state"], ["ingested_at", "label_id"])
    events = _events(spark, folder, "official_state", "final_state", F.coalesce(F.lower("lid"), F.lit("none")).alias("lid"))
    before = F.coalesce(F.col("official_state") == F.col("final_state"), F.lit(False))
    after = F.coalesce(F.col("label_state") == F.col("final_state"), F.lit(False))
    return events.join(last, "event_id").select("lid", before.alias("before"), after.alias("after"))


_PAIRS = f"""{_EV}, {_LATEST},
pr as (select coalesce(lower(lid), 'none') as lid, coalesce(official_state = final_state, false) as before, coalesce(label_state = final_state, false) as after from ev join lab using (event_id))"""


@query(f"with {_PAIRS} select lid, count(*) filter (not before and after) as improved, count(*) filter (before and not after) as regressed, count(*) filter (before = after) as unchanged, 100.0::double * (count(*) filter (after) - count(*) filter (before)) / count(*) as delta_pp from pr group by 1")
def paired_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return stats.transitions(_pairs(spark, folder), ["lid"], F.col("before"), F.col("after"))


@query(f"with {_PAIRS}, m as (select lid, count(*) filter (not before and after) as improved, count(*) filter (before and not after) as regressed from pr group by 1)" + """
select lid, improved, regressed, round(case when improved + regressed = 0 then 1 else least(1.0::double, 2 * list_sum(list_transform(range(least(improved, regressed) + 1),
  lambda i: exp(lgamma(improved + regressed + 1) - lgamma(i + 1) - lgamma(improved + regressed - i + 1) - (improved + regressed) * ln(2::double))))) end, 9) as p_value from m""")
def mcnemar_test(spark: SparkSession, folder: str) -> DataFrame:
    """Exact two-sided p-value by language."""
    moved = paired_transitions(spark, folder)
    return moved.select("lid", "improved", "regressed", F.round(stats.mcnemar(F.col("improved"), F.col("regressed")), 9).alias("p_value"))


@query()
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    deltas = _pairs(spark, folder).select("lid", (F.col("after").cast("int") - F.col("before").cast("int")).alias("delta"))
    return stats.bootstrap(deltas, "lid")


@query("""select coalesce(ntrack, -1) as ntrack, count(*) as sources, round(sum(duration_seconds), 6) as seconds, count(*) filter (structurally_usable) as usable, count(*) filter (metadata_member is null) as without_metadata
from (select source_id, any_value(ntrack) as ntrack, any_value(duration_seconds) as duration_seconds, any_value(structurally_usable) as structurally_usable, any_value(metadata_member) as metadata_member from sources group by 1) group by 1""")
def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings and their length by number of tracks, and what is missing."""
    rows = table(spark, folder, "sources").select("source_id", "ntrack", "duration_seconds", "structurally_usable", "metadata_member").dropDuplicates(["source_id"])
    return rows.groupBy(F.coalesce("ntrack", F.lit(-1)).alias("ntrack")).agg(
        F.count("*").alias("sources"), F.round(F.sum("duration_seconds"), 6).alias("seconds"),
        F.count_if("structurally_usable").alias("usable"), F.count_if(F.col("metadata_member").isNull()).alias("without_metadata"),
    )


@query("""select source_id, ntrack, sample_rate, unnest(list_filter([case when ntrack is null or ntrack not in (2, 3) then 'tracks' end, case when sample_rate is null or sample_rate <> 48000 then 'rate' end,
  case when metadata_member is null then 'metadata' end, case when chunk_count <> ceil(frame_count / 7680.0::double) then 'chunks' end,
  case when abs(duration_seconds - frame_count / 48000.0::double) > 0.001 then 'duration' end], lambda x: x is not null)) as fault
from (select source_id, any_value(ntrack) as ntrack, any_value(sample_rate) as sample_rate, any_value(metadata_member) as metadata_member, any_value(chunk_count) as chunk_count, any_value(frame_count) as frame_count, any_value(duration_seconds) as duration_seconds from sources group by 1)""")
def source_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Structural checks of recordings: tracks, rate, metadata, chunk count and duration against the frames."""
    rows = table(spark, folder, "sources").dropDuplicates(["source_id"])
    faults = F.array_compact(F.array(
        F.when(F.col("ntrack").isNull() | ~F.col("ntrack").isin(2, 3), "tracks"), F.when(F.col("sample_rate").isNull() | (F.col("sample_rate") != 48_000), "rate"),
        F.when(F.col("metadata_member").isNull(), "metadata"), F.when(F.col("chunk_count") != F.ceil(F.col("frame_count") / 7_680.0), "chunks"),
        F.when(F.abs(F.col("duration_seconds") - F.col("frame_count") / 48_000.0) > 0.001, "duration"),
    ))
    return rows.select("source_id", "ntrack", "sample_rate", F.explode(faults).alias("fault"))


@query(f"with {_TL} select a.status as status, a.final_state as final_state, a.activity_source as activity_source, count(*) as events from (select unnest(asg) as a from tl) group by all")
def assignment_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "timelines").select("view_id", "event_assignments").dropDuplicates(["view_id"]).select(F.explode("event_assignments").alias("a"))
    return lines.groupBy("a.status", "a.final_state", "a.activity_source").agg(F.count("*").alias("events"))


@query(f"with {_TL} select count(*) as views, count(*) filter (len(list_filter(states, lambda s: s is null)) > 0) as quarantined_views, sum(len(states))::bigint as chunks, sum(len(list_filter(states, lambda s: s is null)))::bigint as quarantined_chunks from tl")
def quarantine_totals(spark: SparkSession, folder: str) -> DataFrame:
    lost = F.size(F.filter("chunk_states", lambda s: s.isNull()))
    lines = table(spark, folder, "timelines").select("view_id", "chunk_states").dropDuplicates(["view_id"]).filter("chunk_states is not null")
    return lines.agg(F.count("*").alias("views"), F.count_if(lost > 0).alias("quarantined_views"), F.sum(F.size("chunk_states").cast("bigint")).alias("chunks"), F.sum(lost.cast("bigint")).alias("quarantined_chunks"))


@query("""with r as (select cache_signature, result_id, ingested_at from asr_results) select cache_signature, count(*) - 1 as hits, min(ingested_at) as first_ingested_at, arg_min(result_id, (ingested_at, result_id)) as first_result_id from r group by 1""")
def cache_calls(spark: SparkSession, folder: str) -> DataFrame:
    """First use of each signature is a miss, later ones are hits."""
    return cache.call_order(table(spark, folder, "asr_results"), ["cache_signature"], ["ingested_at", "result_id"])


@query("""select count(distinct v.view_id) as missing_views from target_views v where lower(v.view_id) not in (select lower(trim(view_id, chr(9) || ' ')) from asr_results where view_id is not null)""")
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Views that no result is kept for."""
    results = table(spark, folder, "asr_results").select(clean_id(F.col("view_id")).alias("view_id")).filter("view_id is not null")
    return cache.misses(_views(spark, folder), results, "view_id").agg(F.count("*").alias("missing_views"))


@query(f"with {_EV}, {_SEG}, " + """
src as (select source_id, any_value(ntrack) as ntrack, any_value(chunk_count) as n from sources group by 1 having any_value(ntrack) >= 2 and any_value(chunk_count) > 0),
c as (select distinct s.source_id, s.channel, unnest(range(least(lo // 160, n), least((hi + 159) // 160, n))) as chunk from (select *, greatest(lo, 0) as lo0 from seg) s join src on src.source_id = s.source_id where lo >= 0),
k as (select source_id, chunk, list(distinct channel) as tracks from c group by all),
v as (select source_id, unnest(range(ntrack)) as channel, n from src)
select v.source_id || printf('/target-ch%02d', v.channel) as view_id, any_value(n) as chunk_count, count(*) filter (list_contains(tracks, v.channel)) as target_chunks,
  count(*) filter (len(tracks) - list_contains(tracks, v.channel)::int > 0) as other_chunks, count(*) filter (list_contains(tracks, v.channel) and len(tracks) > 1) as overlap_chunks
from v left join k on k.source_id = v.source_id group by v.source_id, v.channel""")
def rebuilt_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views built again from recordings and events, their arrays summed up."""
    events = _events(spark, folder, "source_id", "channel", "speaker_segments_ms")
    views = pipeline.build_views(table(spark, folder, "sources"), events)
    true = lambda c: F.size(F.filter(c, lambda x: x)).cast("bigint")
    return views.select("view_id", "chunk_count", true("target_active_by_chunk").alias("target_chunks"), true("other_active_by_chunk").alias("other_chunks"), true("overlap_by_chunk").alias("overlap_chunks"))


_FALLBACK = """fb as (select ev.event_id, vw.view_id, least(round(env[1])::bigint // 160, least(chunk_count, (round(env[2])::bigint + 159) // 160)) as lo, least(chunk_count, (round(env[2])::bigint + 159) // 160) as hi
  from ev join (select event_id, any_value(activity_fallback_candidate) as candidate from final_events group by 1) using (event_id) join vw on vw.source_id = ev.source_id and vw.channel = ev.channel
  where candidate and isfinite(env[1]) and isfinite(env[2]) and round(env[2]) > round(env[1]) and ev.event_id not in (select event_id from seg)),
tk as (select result_id, place, k.view_id, end_ms, chunk_count, ta, least(floor(start_ms / 160.0::double), least(len(ta), ceil(end_ms / 160.0::double)))::bigint as lo, least(len(ta), ceil(end_ms / 160.0::double))::bigint as hi
  from (select result_id, view_id, place, t.* from (select result_id, lower(trim(any_value(view_id), chr(9) || ' ')) as view_id, unnest(any_value(tokens)) as t, unnest(range(len(any_value(tokens)))) as place from asr_results group by result_id)) k
  join vw using (view_id) where isfinite(start_ms) and isfinite(end_ms) and end_ms >= start_ms and start_ms >= 0),
tt as (select *, coalesce(list_bool_or(ta[greatest(lo - 2, 0) + 1:least(hi + 2, len(ta))]), false) as active from tk),
pairs as (select tt.view_id, result_id, place, event_id from tt join fb on fb.view_id = tt.view_id and tt.lo < fb.hi + 2 and tt.hi > fb.lo - 2)"""
_WHOLE = f"{_EV}, {_SEG}, {_CELL}, {_VIEW}, {_FALLBACK}, " + """
every as (select view_id, event_id, chunk from cell join vw using (view_id) where chunk < chunk_count union select view_id, event_id, unnest(range(lo, hi)) from fb where event_id in (select event_id from pairs)), """ + _CLAIM.replace("from cell c", "from every c") + """,
fo as (select view_id, unnest(range(lo, hi)) as chunk, 'fallback' as kind from fb where event_id not in (select event_id from pairs)
  union select view_id, greatest(0, least(chunk_count - 1, ceil(end_ms / 160.0::double) - 1))::bigint, 'outside' from tt where not active and (result_id, place) not in (select (result_id, place) from pairs)),
x as (select view_id, chunk, min(state) as lo, max(state) as hi, bool_or(kind = 'activity') as covered from cl group by all),
sz as (select vw.view_id, greatest(chunk_count, least(coalesce(l.last + 1, 0), chunk_count + 1)) as n from vw left join (select view_id, max(chunk) as last from cl where kind = 'terminal' group by 1) l using (view_id)),
g as (select view_id, unnest(range(n)) as chunk from sz),
a as (select view_id, i as chunk from (select view_id, unnest(ta) as t, unnest(range(len(ta))) as i from vw) where t),
q as (select view_id, chunk, kind from fo union all select g.view_id, g.chunk, 'conflict' from g join x on x.view_id = g.view_id and x.chunk = g.chunk where x.lo <> x.hi
  union all select a.view_id, a.chunk, 'uncovered' from a left join x on x.view_id = a.view_id and x.chunk = a.chunk where not coalesce(x.covered, false))"""


def _whole(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What timelines are built of: views, events (repeated rows change nothing), and recognition results."""
    views = _views(spark, folder, "chunk_count", "target_active_by_chunk")
    names = ("event_id", "source_id", "channel", "final_state", "speaker_segments_ms", "activity_fallback_candidate", "effective_event_envelope_ms")
    events = table(spark, folder, "final_events").select(*names)
    times = F.transform("tokens", lambda t: F.struct(t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms")))
    results = table(spark, folder, "asr_results").select("result_id", clean_id(F.col("view_id")).alias("view_id"), times.alias("tokens")).dropDuplicates(["result_id"])
    return views, events, results


@query(f"with {_EV}, {_SEG}, {_VIEW}, {_FALLBACK}, " + """
n as (select view_id, list_sort(list(distinct event_id)) as event_ids from pairs group by 1)
select tt.view_id, count(*) as tokens, count(*) filter (active or (result_id, place) in (select (result_id, place) from pairs)) as evidenced, coalesce(any_value(event_ids), []) as event_ids from tt left join n on n.view_id = tt.view_id group by 1""")
def token_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Timed tokens of each view, those near activity or the envelope of a fallback event, and the fallback events with a token near."""
    views, events, results = _whole(spark, folder)
    heard, pairs = tokens.evidence(results, views, pipeline.fallback_envelopes(views, events))
    counted = heard.groupBy("view_id").agg(F.count("*").alias("tokens"), F.count_if("active").alias("near"))
    added = F.count_distinct(F.when(~F.col("active"), F.struct("result_id", "place"))).alias("added")
    found = pairs.groupBy("view_id").agg(added, F.array_sort(F.collect_set("event_id")).alias("event_ids"))
    evidenced = F.col("near") + F.coalesce("added", F.lit(0))
    return counted.join(found, "view_id", "left").select("view_id", "tokens", evidenced.alias("evidenced"), F.coalesce("event_ids", F.array().cast("array<string>")).alias("event_ids"))


@query(f"with {_WHOLE}" + """
select g.view_id, coalesce(p.kind, x.lo, 'user_idle') as outcome, count(*) as chunks from g left join x on x.view_id = g.view_id and x.chunk = g.chunk
  left join (select view_id, chunk, arg_min(kind, case kind when 'fallback' then 1 when 'outside' then 2 when 'uncovered' then 3 else 4 end) as kind from q group by all) p on p.view_id = g.view_id and p.chunk = g.chunk group by all""")
def state_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved state of every chunk with recognition results heard, counted per view and outcome."""
    found = pipeline.resolved(*_whole(spark, folder))
    return timeline.outcomes(found.cells, found.lengths)


@query(f"with {_WHOLE}, " + """
cf as (select distinct event_id from cl join x on x.view_id = cl.view_id and x.chunk = cl.chunk where x.lo <> x.hi),
fc as (select event_id, coalesce(any_value(activity_fallback_candidate), false) as candidate from final_events group by 1),
st8 as (select event_id, case when event_id in (select event_id from seg) then 'speaker_segments' when candidate then 'event_envelope_fallback' else 'none' end as activity_source,
  case when event_id in (select event_id from cf) then 'state_conflict' when event_id in (select event_id from seg) or candidate and event_id in (select event_id from pairs) then 'applied' when candidate then 'missing_evidence' else 'non_acoustic_placeholder' end as status from fc)
select activity_source, status, count(*) as events from st8 group by all""")
def event_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Events by what their activity is known from and whether it was applied: conflicts fall on all who claim the chunk."""
    views, events, results = _whole(spark, folder)
    found = pipeline.resolved(views, events, results)
    facts = events.dropDuplicates(["event_id"]).select("event_id", (F.size(valid_pairs(F.col("speaker_segments_ms"))) > 0).alias("spoken"), F.coalesce("activity_fallback_candidate", F.lit(False)).alias("candidate"))
    return timeline.statuses(facts, found.evidenced, found.claimed, found.cells).groupBy("activity_source", "status").agg(F.count("*").alias("events"))


@query(f"with {_WHOLE}, " + """
i as (select view_id, kind, chunk, chunk - row_number() over (partition by view_id, kind order by chunk) as isl from (select distinct view_id, kind, chunk from q))
select view_id, kind, min(chunk)::int as start_chunk, (max(chunk) + 1)::int as stop_chunk from i group by view_id, kind, isl""")
def quarantined_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of chunks of all four kinds of quarantine; a chunk may be of several."""
    return pipeline.build_timelines(*_whole(spark, folder))[1]


def _export_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Stored timelines as lines of the export; the audio tokens of chunk c are 2c and 2c + 1 (there are none stored)."""
    lines = table(spark, folder, "timelines").dropDuplicates(["view_id"])
    audio = F.transform("chunk_states", lambda s, i: F.array(F.pmod(i * 2, F.lit(51_866)), F.pmod(i * 2 + 1, F.lit(51_866))))
    other = F.transform("other_active_count_by_chunk", lambda n: n > 0)
    return lines.select("view_id", "source_id", F.col("target_channel").alias("channel"), "overlap_by_chunk", "event_assignments",
                        F.transform("chunk_states", _state_name).alias("chunk_states"), F.col("chunk_asr_targets").alias("chunk_texts"), audio.alias("chunk_audio"), other.alias("other_active_by_chunk"))


_GROUPS = """, src as (select view_id, any_value(source_id) as source_id, any_value(target_channel) as ch, any_value(other_active_count_by_chunk) as oc, any_value(overlap_by_chunk) as ov from timelines group by 1),
g0 as (select view_id, u.i as i, coalesce(u.t, '') as t, regexp_replace(lower(trim(regexp_replace(u.s, '<\\||\\|>', '', 'g'))), '[\\s_-]+', '_', 'g') as s from (select view_id, unnest(list_transform(range(1, len(states) + 1), lambda i: {'i': i, 's': states[i], 't': txt[i]})) as u from tl)),
g as (select *, coalesce(s in ('user_idle', 'user_nonidle', 'user_complete', 'user_incomplete', 'user_backchannel') and not contains(t, '<|') and not contains(t, '|>'), false) as ok from g0),
c as materialized (select view_id, i, case when ok then 4 + length(t) else 1000000 end as c from g)""".replace("\\\\", "\\")
_FOLD = _PACKED[_PACKED.index(",\np(view_id") :]


@query(f"with recursive {_TL}{_GROUPS}{_FOLD}" + """,
w as (select view_id, min(i) - 1 as lo, max(i) as hi, max(cost) as cost from p where not skip group by view_id, w),
x as (select w.view_id, lo, hi, cost, string_agg('<|audio_' || ((i - 1) * 2 % 51866) || '|><|audio_' || (((i - 1) * 2 + 1) % 51866) || '|>' || t || '<|end_of_sentence|><|' || s || '|>', '' order by i) as body from w join g on g.view_id = w.view_id and g.i > w.lo and g.i <= w.hi group by all),
a as (select view_id, unnest(asg) as e from tl),
r as (select view_id, e.event_id as event_id, unnest(coalesce(e.activity_chunk_ranges, []) || [[e.decision_chunk, e.decision_chunk + 1]]) as r from a where e.event_id is not null),
n as (select w.view_id, w.lo, list_sort(list(distinct event_id)) as ids from w join r on r.view_id = w.view_id and r.r[1] < w.hi and r.r[2] > w.lo and r.r[1] < r.r[2] group by all)
select 'dlgset__' || source_id || printf('__ch%02d__c%06d-%06d', ch, x.lo, x.hi) as window_index, x.view_id, source_id, [x.lo::int, x.hi::int] as chunk_range, (x.hi - x.lo)::int as chunk_count, cost::int as tokenized_length,
  len(list_filter(oc[x.lo + 1:x.hi], lambda y: y > 0))::int as other_active_chunk_count, len(list_filter(ov[x.lo + 1:x.hi], lambda y: y))::int as overlap_chunk_count,
  '<|task_duplex_predict|><|punctuation_off|>' || body as sequence, coalesce(ids, []) as event_ids from x join src using (view_id) left join n on n.view_id = x.view_id and n.lo = x.lo""")
def exported_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences packed from the stored timelines, with the events of each window."""
    return pipeline.export_sequences(_export_lines(spark, folder), set_name="dlgset")


@query(f"with {_TL}, " + r"""
c as (select view_id, unnest(states) as s, coalesce(unnest(txt), '') as t, unnest(range(len(states))) as i from tl)
select view_id, i::int as chunk, (6 + length(t))::int as cost from c where regexp_replace(lower(trim(regexp_replace(s, '<\||\|>', '', 'g'))), '[\s_-]+', '_', 'g') in ('user_idle', 'user_nonidle', 'user_complete', 'user_incomplete', 'user_backchannel')
  and not contains(t, '<|') and not contains(t, '|>') and 6 + length(t) > 1500""")
def exported_oversized(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that the export leaves out as over the budget alone."""
    return pipeline.oversized_chunks(_export_lines(spark, folder))


def _state_name(raw):
    """A stored state however it is spelled."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(raw, r"<\||\|>", ""))), r"[\s_-]+", "_")


@query(f"with {_TL}, " + """f as (select view_id, unnest(list_filter([case when len(states) = 0 then 'empty' end,
  case when len(list_filter(states, lambda s: s is null or not regexp_matches(lower(s), 'idle|complete|backchannel|^unknown$'))) > 0 then 'state' end], lambda x: x is not null)) as fault from tl where states is not null)
select fault, count(*) as traces from f group by 1""")
def trace_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines read as traces, by fault; null and unreadable states are faults. They hold no timestamps, so ``time`` can't be one."""
    lines = table(spark, folder, "timelines").select("view_id", "chunk_states").dropDuplicates(["view_id"]).filter("chunk_states is not null")
    names = lambda s: F.when(s.rlike("(?i)nonidle"), "nonidle").when(s.rlike("(?i)idle"), "idle").when(s.rlike("(?i)incomplete"), "wait").when(s.rlike("(?i)complete"), "speak").when(s.rlike("(?i)backchannel"), "backchannel").when(s.rlike("(?i)^unknown$"), "unknown")
    step = lambda s, i: F.struct(names(s).alias("state"), F.array(i * F.lit(0.16), (i + 1) * F.lit(0.16)).alias("timestamp"))
    return lines.select(F.explode(contracts.trace_faults(F.transform("chunk_states", step))).alias("fault")).groupBy("fault").agg(F.count("*").alias("traces"))


#: Names under which the full rules were first registered beside narrower ones, which they have since replaced.
for _name, _query in {
    "token_contract": "token_faults", "window_event_ids": "window_events", "fallback_evidence": "token_evidence", "view_timeline": "state_timeline",
    "view_quarantines": "quarantined_ranges", "trace_state_faults": "trace_contract", "label_origins": "label_precedence",
}.items():
    QUERIES[_name], ORACLE[_name] = QUERIES[_query], ORACLE[_query]
