"""Queries of label requests and of finalising, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.bounds import valid_pair
from turnloom.functions.ids import clean_id
from turnloom.operators import contracts, requests
from turnloom.plans.dialogue import _EV, _VIEW, _events, _views, query
from turnloom.session import cut, table


@query(f"with {_EV}, {_VIEW}, " + """
e as (select ev.*, least(round(env[1])::bigint // 160, hi0) as lo, hi0 as hi from (select ev.*, vw.chunk_count, ta, oa, ov, oc, least(chunk_count, (round(env[2])::bigint + 159) // 160) as hi0 from ev join vw on vw.source_id = ev.source_id and vw.channel = ev.channel
  where isfinite(env[1]) and isfinite(env[2]) and round(env[2]) > round(env[1]) and env[1] >= 0) ev)
select event_id, source_id, row_number() over (partition by source_id order by case when isfinite(start_ms) then start_ms end nulls last, channel, ordinal, event_id) - 1 as place,
  case when official_state is null then 'TO_LABEL' else official_state end as state_context, lo as chunk_start, hi as chunk_stop, (hi - lo)::int as chunk_span,
  len(list_filter(ta[lo + 1:hi], lambda x: x))::int as target_chunks, len(list_filter(oa[lo + 1:hi], lambda x: x))::int as other_chunks, len(list_filter(ov[lo + 1:hi], lambda x: x))::int as overlap_chunks, coalesce(list_max(oc[lo + 1:hi]), 0)::int as most_other from e""")
def request_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of each recording in the order of time, as a label request lists them: those without a state are to be labelled."""
    names = ["target_active_by_chunk", "other_active_by_chunk", "overlap_by_chunk", "other_active_count_by_chunk"]
    views = _views(spark, folder, "source_id", F.col("target_channel").alias("channel"), "chunk_count", *names)
    events = _events(spark, folder, "source_id", "channel", "ordinal", "start_ms", "official_state", valid_pair(F.col("effective_event_envelope_ms")).alias("x")).filter("x is not null and x.start >= 0")
    context = contracts.label_context(F.col("official_state"), F.col("official_state").isNull()).alias("state_context")
    rows = requests.relations(events.select("event_id", "source_id", "channel", "ordinal", "start_ms", context, "x.start", "x.stop"), views, names)
    return requests.timed_places(cut(rows), "source_id", "start_ms", ["channel", "ordinal", "event_id"]).drop("channel", "ordinal", "start_ms")


@query(f"with {_EV} select source_id, count(*) as events, sum(('0x' || sha256(event_id)[1:12])::bigint)::varchar as digest, least(8192, greatest(1024, count(*) * 160)) as max_tokens from ev where official_state is null group by 1")
def request_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of each recording: events to label, what names them, and the tokens the answer may take."""
    return requests.request_sizes(_events(spark, folder, "source_id", "official_state").filter("official_state is null"))


@query(f"with {_EV}" + """, l as (select distinct nullif(lower(trim(event_id, chr(9) || ' ')), '') as event_id from state_labels),
w as (select event_id, split_part(event_id, '/', 1) as source_id from l where event_id is not null)
select fault, count(*) as events from (
  select 'unknown' as fault from w where (source_id, event_id) not in (select (source_id, event_id) from ev)
  union all select 'no view' from ev where source_id in (select source_id from w) and (source_id, channel) not in (select (source_id, target_channel) from target_views)) group by 1""")
def request_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What would forbid a request of the labelled events: ids of no event, and tracks without a view."""
    wanted = table(spark, folder, "state_labels").select(clean_id(F.col("event_id")).alias("event_id")).filter("event_id is not null").distinct()
    wanted = wanted.withColumn("source_id", F.substring_index("event_id", "/", 1))
    views = _views(spark, folder, "source_id", F.col("target_channel").alias("channel"))
    return requests.request_faults(_events(spark, folder, "source_id", "channel"), wanted, views).groupBy("fault").agg(F.count("*").alias("events"))


_GIVEN = "gv as (select event_id, count(*) as n, min(label_state) as label_state, bool_and(coalesce(label_state in ('complete', 'incomplete', 'backchannel'), false)) as good from (select any_value(nullif(lower(trim(event_id, chr(9) || ' ')), '')) as event_id, any_value(label_state) as label_state from state_labels group by label_id) where event_id is not null group by 1)"


def _given(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "state_labels").select("label_id", clean_id(F.col("event_id")).alias("event_id"), "label_state").dropDuplicates(["label_id"])
    return rows.filter("event_id is not null").select("event_id", "label_state")


@query(f"with {_EV}, {_GIVEN}" + """
select event_id, case when official_state = 'wait' then 'complete' when official_state is not null then official_state else label_state end as final_state,
  case when official_state = 'wait' then 'wait_as_complete' when official_state is not null then 'official' when label_state is not null then 'substitute' else 'none' end as state_label_source,
  case when official_state = 'wait' then 'mapped' when official_state is not null then 'official' when label_state is not null then 'pseudolabel' end as quality from ev left join gv using (event_id)""")
def finalised_events(spark: SparkSession, folder: str) -> DataFrame:
    """Final state of each event, where it is from and how good that is."""
    return requests.finalised(_events(spark, folder, "official_state"), _given(spark, folder))[0]


@query(f"with {_EV}, {_GIVEN}, " + """j as (select *, ev.event_id is not null as known from ev full join gv using (event_id)),
f as (select unnest(list_filter([case when n > 1 then 'duplicate' end, case when not known then 'unknown' end, case when not good then 'state' end, case when known and official_state is null and n is null then 'missing' end,
  case when official_state not in ('complete', 'incomplete', 'backchannel', 'wait') then 'unsupported' end], lambda x: x is not null)) as fault from j) select fault, count(*) as events from f group by 1""")
def finalising_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What stands against finalising: duplicate, unknown and unreadable labels, and events without any."""
    return requests.finalised(_events(spark, folder, "official_state"), _given(spark, folder))[1].groupBy("fault").agg(F.count("*").alias("events"))


@query(f"with {_EV}" + """, rq as (select source_id as signature, list(event_id) as asked from ev where official_state is null group by 1),
rs as (select split_part(event_id, '/', 1) as signature, list(event_id) as ids, list(coalesce(state, '')) as states, list(coalesce(confidence, -1)) as conf, any_value(model) as model from
  (select any_value(nullif(lower(trim(event_id, chr(9) || ' ')), '')) as event_id, any_value(label_state) as state, any_value(confidence) as confidence, 'judge' as model from state_labels group by label_id) where event_id is not null group by 1),
f as (select unnest(list_filter([case when asked is null then 'unknown' end,
  case when len(list_filter(asked, lambda x: not list_contains(ids, x))) > 0 then 'unanswered' end, case when asked is not null and len(list_filter(ids, lambda x: not list_contains(asked, x))) > 0 then 'unasked' end,
  case when asked is not null and len(list_distinct(ids)) <> len(ids) then 'repeated' end, case when asked is not null and len(list_filter(states, lambda x: x not in ('complete', 'incomplete', 'backchannel', 'wait'))) > 0 then 'state' end,
  case when asked is not null and len(list_filter(conf, lambda x: x < 0 or x > 1)) > 0 then 'confidence' end], lambda x: x is not null)) as fault from rs left join rq using (signature))
select fault, count(*) as responses from f group by 1""")
def response_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a recording read as the response to its request: what is wrong with them."""
    asked = _events(spark, folder, "source_id", "official_state").filter("official_state is null").groupBy(F.col("source_id").alias("signature")).agg(F.collect_list("event_id").alias("event_ids"))
    rows = table(spark, folder, "state_labels").select("label_id", clean_id(F.col("event_id")).alias("event_id"), F.col("label_state").alias("state"), "confidence").dropDuplicates(["label_id"]).filter("event_id is not null")
    given = rows.groupBy(F.substring_index("event_id", "/", 1).alias("signature")).agg(F.collect_list(F.struct("event_id", "state", "confidence", F.lit("given").alias("reason"))).alias("labels"))
    return requests.response_rows(given.withColumn("model", F.lit("judge")), asked, "judge")[1].filter("fault <> 'answered twice'").groupBy("fault").agg(F.count("*").alias("responses"))
