"""SQL for those of the subpackage's queries that SQL can express."""

from __future__ import annotations

#: White space around ids.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\pZ]"


def _clean(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '')"


_CONTROL = r"<\|[^<|>]+\|>"
_STATE = r"<\|user_(?:idle|nonidle|complete|incomplete|backchannel)\|>"

_P2 = rf"""
with long as (select distinct window_index, sequence from model_ready where length(regexp_replace(sequence, '{_CONTROL}', 'x', 'g')) > 1500),
b as (select window_index, regexp_replace(sequence, '^(?:<\|task_duplex_predict\|>)?(?:<\|punctuation_off\|>)?', '') as body from long),
parts as (select window_index, unnest(string_split_regex(regexp_replace(body, '{_STATE}', chr(1), 'g'), chr(1))) as part from b),
sized as (select window_index, length(regexp_replace(part, '{_CONTROL}', 'x', 'g')) + 1 as n from parts)
select window_index, case when max(n) + 2 > 1500 then 'inside' else 'between' end as cut_at from sized group by 1
"""


def _p6(least: int) -> str:
    return rf"""
with raw as (
  select row_number() over () as r, {_clean('view_id')} as view_id, chunk_states, target_active_by_chunk from timelines),
cells as (
  select r, view_id, 'chunk_states' as field, unnest(chunk_states) as v, unnest(range(len(chunk_states))) as i from raw
  union all
  select r, view_id, 'target_active_by_chunk', case when x then 'active' when not x then 'inactive' end, i
  from (select r, view_id, unnest(target_active_by_chunk) as x, unnest(range(len(target_active_by_chunk))) as i from raw)),
named as (
  select r, view_id, field, i, case when field = 'chunk_states'
    then regexp_replace(lower(trim(replace(replace(v, '<|', ''), '|>', ''))), '[-_\s]+', '_', 'g') else v end as s from cells),
kept as (select * from named where s in ('user_idle', 'user_nonidle', 'user_complete', 'user_incomplete', 'user_backchannel', 'active', 'inactive')),
isl as (select *, i - row_number() over (partition by r, field, s order by i) as g from kept)
select distinct view_id, field, s as run_state, min(i)::int as start_chunk, count(*)::int as chunk_count@extra
from isl group by r, view_id, field, s, g having count(*) >= {least}
"""


_SEGMENTS = f"""
select distinct {_clean('source_id')} || printf('/target-ch%02d', channel) as view_id, event_id, round(x[1])::bigint as lo, round(x[2])::bigint as hi
from (select source_id, channel, event_id, unnest(speaker_segments_ms) as x from final_events)
where isfinite(x[1]) and isfinite(x[2]) and round(x[2]) > round(x[1])
"""

_P3_NEAREST = f"""
with t as (select view_id, x.token_index as token_index, (x.start_ms + x.end_ms) / 2 as tm
           from (select {_clean('view_id')} as view_id, unnest(tokens) as x from asr_results)),
tk as (select distinct * from t where isfinite(tm)),
s as ({_SEGMENTS}),
d as (select tk.view_id, token_index, tm, event_id, lo, greatest(lo - tm, tm - hi, 0) as away
      from tk join s on s.view_id = tk.view_id and s.lo - 320 <= tm and s.hi + 320 >= tm),
r as (select *, row_number() over (partition by view_id, token_index, tm order by away, lo, event_id) as n from d)
select view_id, token_index, tm as time_ms, event_id, away::double as away_ms from r where n = 1
"""

_P4 = f"""
with recursive w as (select nullif({_clean('source_id')}, 'unknown') as a,
                            nullif({_clean("split_part(" + _clean('view_id') + ", '/', 1)")}, 'unknown') as b from windows),
e as (select distinct a, b from w where a <> b union select distinct b, a from w where a <> b),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
select distinct a as source_a, b as source_b from reach where a < b
"""

_NAMED = f"""w as (select window_index, nullif({_clean('source_id')}, 'unknown') as a, nullif({_clean("split_part(" + _clean('view_id') + ", '/', 1)")}, 'unknown') as b from windows),
e as (select distinct a, b from w where a <> b union select distinct b, a from w where a <> b),
reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
c as (select a as node, least(a, min(b)) as component from reach group by a)"""

_P4_MEMBERS = f"with recursive {_NAMED} select node as source_id, component, (select count(*) from e where e.a = c.node) as links from c"

_P4_SPLIT = f"""with recursive {_NAMED},
t as (select window_index, coalesce(component, n, 'window:' || coalesce(window_index, '')) as component
      from (select distinct window_index, coalesce(a, b) as n from w) d left join c on c.node = d.n),
g as (select component, count(*) as n from t group by 1),
p as (select component, ('0x' || sha256('42:' || component)[1:12])::bigint / 281474976710656.0::double as spot, n > (select sum(n) from g) * 0.05::double as heavy from g)
select window_index, component, case when heavy or spot < 0.8::double then 'train' when spot < 0.9::double then 'validation' else 'test' end as split from t join p using (component)"""


ORACLE = {
    "p3_found": f"select distinct view_id, token_index, event_id from ({_P3_NEAREST})",
    "p3_nearest": _P3_NEAREST,
    "p4_found": _P4,
    "p4_members": _P4_MEMBERS,
    "p4_split": _P4_SPLIT,
    "p4_shares": f"select split, count(*) as windows, count(distinct component) as components, round(count(*) / sum(count(*)) over ()::double, 4) as share from ({_P4_SPLIT}) group by 1",
    "p2_found": _P2,
    "p6_found": _p6(2).replace("@extra", ""),
    "p6_runs": _p6(1).replace("@extra", ", count(*) * 160 as duration_ms"),
}
