"""Queries of the general data problems (p1, p5) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.bounds import valid_pair, valid_pairs
from turnloom.functions.ids import clean_id, view_id
from turnloom.operators.intervals import periods_and_gaps
from turnloom.operators.references import orphan_references
from turnloom.session import table


def activity_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """(view_id, basis, start, stop) of all valid intervals: ``ms`` from events, ``chunk`` from timelines."""
    events = table(spark, folder, "final_events")
    bare = F.col("activity_fallback_candidate") & (F.size(valid_pairs(F.col("speaker_segments_ms"))) == 0)
    chosen = F.when(bare, F.array("effective_event_envelope_ms")).otherwise(F.col("speaker_segments_ms"))
    spoken = events.select(view_id(clean_id(F.col("source_id")), F.col("channel")).alias("view_id"), F.lit("ms").alias("basis"), F.explode(chosen).alias("pair"))
    lines = table(spark, folder, "timelines").select(clean_id(F.col("view_id")).alias("view_id"), F.explode("event_assignments.activity_chunk_ranges").alias("ranges"))
    active = lines.select("view_id", F.lit("chunk").alias("basis"), F.explode("ranges").alias("pair"))
    rows = [x.select("view_id", "basis", valid_pair(F.col("pair")).alias("x")) for x in (spoken, active)]
    return rows[0].unionByName(rows[1]).filter("x is not null").select("view_id", "basis", "x.start", "x.stop")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = periods_and_gaps(activity_intervals(spark, folder), ["view_id", "basis"])
    return found.select("view_id", "basis", "kind", "start_at", "stop_at")


def p5_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """References of the three fields, and the rows of their targets."""
    labels, results = table(spark, folder, "state_labels"), table(spark, folder, "asr_results")
    at = F.col("ingested_at").alias("at")
    tokens = "fallback_event_ids_with_token_evidence"

    def field(rows: DataFrame, kind: str, name: str, row_key: str, ref: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.col(row_key).alias("row_key"), clean_id(F.col(ref)).alias("key"), "at")

    listed = results.select("result_id", at, F.explode(tokens).alias("ref"))
    refs = (
        field(labels.select("label_id", "event_id", at), "event", "state_labels.event_id", "label_id", "event_id")
        .unionByName(field(results.select("result_id", "view_id", at), "view", "asr_results.view_id", "result_id", "view_id"))
        .unionByName(field(listed, "event", f"asr_results.{tokens}", "result_id", "ref"))
    )
    when = [F.col("ingested_at").alias("arrived"), F.col("deleted_at").alias("deleted")]
    parents = (
        table(spark, folder, "final_events").select(F.lit("event").alias("kind"), clean_id(F.col("event_id")).alias("key"), *when)
        .unionByName(table(spark, folder, "target_views").select(F.lit("view").alias("kind"), clean_id(F.col("view_id")).alias("key"), *when))
    )
    return refs, parents


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(*p5_references(spark, folder))
    return found.select(F.col("field").alias("ref_field"), "row_key", F.col("key").alias("ref_id"), "reason", F.col("month").alias("ref_month"))


def p5_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per field, reason and month."""
    rows = p5_found(spark, folder).groupBy("ref_field", "reason", "ref_month")
    return rows.agg(F.count("*").alias("orphan_refs"), F.countDistinct("ref_id").alias("orphan_keys"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_by_period": p5_by_period}

#: White space around ids, as in ``functions.ids.SPACE``.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\pZ]"


def _clean(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '')"


def _valid(lo: str, hi: str) -> str:
    return f"isfinite({lo}) and isfinite({hi}) and round({hi}) > round({lo})"


_P1 = f"""
with ev as (select row_number() over () as r, {_clean('source_id')} || printf('/target-ch%02d', channel) as view_id, speaker_segments_ms as segs,
                   activity_fallback_candidate as fb, effective_event_envelope_ms as env from final_events),
seg as (select r, view_id, x[1] as lo, x[2] as hi from (select r, view_id, unnest(segs) as x from ev)),
okseg as (select r, view_id, round(lo)::bigint as lo, round(hi)::bigint as hi from seg where {_valid('lo', 'hi')}),
okenv as (select view_id, round(env[1])::bigint as lo, round(env[2])::bigint as hi from ev
          where fb and r not in (select r from okseg) and {_valid('env[1]', 'env[2]')}),
asg as (select {_clean('view_id')} as view_id, unnest(event_assignments).activity_chunk_ranges as rs from timelines),
rng as (select view_id, x[1]::bigint as lo, x[2]::bigint as hi from (select view_id, unnest(rs) as x from asg)),
iv as (select view_id, 'ms' as basis, lo, hi from okseg union all select view_id, 'ms', lo, hi from okenv
       union all select view_id, 'chunk', lo, hi from rng where hi > lo),
m as (select *, max(hi) over (partition by view_id, basis order by lo, hi rows between unbounded preceding and 1 preceding) as top
      from (select distinct * from iv) where view_id is not null),
g as (select *, sum(case when top is null or lo > top then 1 else 0 end) over (partition by view_id, basis order by lo, hi rows unbounded preceding) as island from m),
p as (select view_id, basis, min(lo) as start_at, max(hi) as stop_at from g group by view_id, basis, island),
n as (select *, lead(start_at) over (partition by view_id, basis order by start_at) as nxt from p)
select view_id, basis, 'period' as kind, start_at, stop_at from n
union all select view_id, basis, 'gap', stop_at, nxt from n where nxt is not null
"""

_P5 = f"""
with refs as (
  select 'event' as kind, 'state_labels.event_id' as ref_field, label_id as row_key, {_clean('event_id')} as ref_id, ingested_at as t from state_labels
  union all select 'view', 'asr_results.view_id', result_id, {_clean('view_id')}, ingested_at from asr_results
  union all select 'event', 'asr_results.fallback_event_ids_with_token_evidence', result_id, {_clean('x')}, t
    from (select result_id, ingested_at as t, unnest(fallback_event_ids_with_token_evidence) as x from asr_results)),
homes as (select 'event' as kind, {_clean('event_id')} as key, ingested_at as a, deleted_at as d from final_events
          union all select 'view', {_clean('view_id')}, ingested_at, deleted_at from target_views),
firsts as (select kind, key, min(a) as first from homes group by kind, key)
select distinct ref_field, row_key, ref_id,
  case when f.key is null then 'missing' when coalesce(f.first, timestamp '9999-01-01') > t then 'late' else 'deleted' end as reason,
  strftime(t, '%Y-%m') as ref_month
from refs left join firsts f on f.kind = refs.kind and f.key = refs.ref_id
where ref_id is not null and t is not null
  and not exists (select 1 from homes h where h.kind = refs.kind and h.key = refs.ref_id and h.a <= t and (h.d is null or h.d > t))
"""

ORACLE = {
    "p1_found": _P1,
    "p5_found": _P5,
    "p5_by_period": f"select ref_field, reason, ref_month, count(*) as orphan_refs, count(distinct ref_id) as orphan_keys from ({_P5}) group by all",
}
