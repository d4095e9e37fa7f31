"""Queries of the evaluation and training-choice operators over labels and events, with their SQL.

Judges of ``state_labels`` stand for checkpoints: the baseline is the official
state of an event, a candidate the judge's label, and what is right the final
state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.ids import clean_id
from turnloom.operators import evaluation
from turnloom.plans.dialogue import _events, query
from turnloom.session import table

#: Fixed values of these queries: steps of the judges as checkpoints, weights of the heads.
STEPS = {"judge-a": 100, "judge-b": 200, "hand": 300}
WEIGHTS = {"complete": 0.4, "incomplete": 0.4, "backchannel": 0.2}

_OUT = """ev0 as (select event_id, any_value(source_id) as source_id, coalesce(lower(any_value(lid)), 'none') as lid, any_value(official_state) as official_state, any_value(final_state) as final_state from final_events group by 1),
lb0 as (select label_id, any_value(nullif(lower(trim(event_id, chr(9) || ' ')), '')) as event_id, any_value(lower(label_state)) as label_state, any_value(label_profile) as profile, any_value(confidence) as confidence, date_trunc('month', min(ingested_at)) as month from state_labels group by 1),
o as (select label_id, event_id, source_id, lid, final_state as label, profile, case profile when 'judge-a' then 100 when 'judge-b' then 200 else 300 end as step, confidence, month,
  coalesce(official_state = final_state, false) as before, coalesce(label_state = final_state, false) as after from lb0 join ev0 using (event_id)),
cls as (select step, lid, label, count(*) as total, count(*) filter (before) as b, count(*) filter (after) as c, count(*) filter (not before and after) as improved, count(*) filter (before and not after) as regressed from o group by all)"""


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A row per label of a known event: step, language and final state, and whether baseline and candidate are right."""
    given = table(spark, folder, "state_labels").groupBy("label_id").agg(
        F.first("event_id").alias("event_id"), F.first("label_state").alias("label_state"), F.first("label_profile").alias("profile"),
        F.first("confidence").alias("confidence"), F.date_trunc("month", F.min("ingested_at")).alias("month"),
    )
    given = given.withColumn("event_id", clean_id(F.col("event_id"))).withColumn("label_state", F.lower("label_state"))
    events = _events(spark, folder, "source_id", F.coalesce(F.lower("lid"), F.lit("none")).alias("lid"), "official_state", "final_state")
    step = F.when(F.col("profile") == "judge-a", STEPS["judge-a"]).when(F.col("profile") == "judge-b", STEPS["judge-b"]).otherwise(STEPS["hand"])
    right = lambda c: F.coalesce(F.col(c) == F.col("final_state"), F.lit(False))
    return given.join(events, "event_id").select(
        "label_id", "event_id", "source_id", "lid", F.col("final_state").alias("label"), "profile", step.alias("step"), "confidence", "month",
        right("official_state").alias("before"), right("label_state").alias("after"),
    )


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.compared_classes(_outcomes(spark, folder), ["step", "lid", "label"], F.col("before"), F.col("after"))


@query(f"with {_OUT}" + """
select step, lid, label, total, b as baseline_correct, c as candidate_correct, improved, regressed, total - improved - regressed as unchanged,
  100.0::double * b / total as baseline_percent, 100.0::double * c / total as candidate_percent, 100.0::double * (c - b) / total as delta_pp,
  round(case when improved + regressed = 0 then 1 else least(1.0::double, 2 * list_sum(list_transform(range(least(improved, regressed) + 1),
    lambda i: exp(lgamma(improved + regressed + 1) - lgamma(i + 1) - lgamma(improved + regressed - i + 1) - (improved + regressed) * ln(2::double))))) end, 9) as p_value from cls""")
def class_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline and candidate of each step, language and state, with the exact test of their discordant pairs."""
    return _classes(spark, folder)


_SWEEP = f"""{_OUT},
mac as (select step, lid, avg(100.0::double * c / total) as pc, avg(100.0::double * c / total) - avg(100.0::double * b / total) as macro, min(100.0::double * (c - b) / total) as low from cls group by all),
cp as (select step, round(min(macro), 9) as lowest_macro_pp, round(min(low), 9) as lowest_class_pp from mac group by 1),
fl as (select *, lowest_macro_pp >= -1 and lowest_class_pp >= -2 as almost_unchanged, lowest_macro_pp < -3 or lowest_class_pp < -5 as decline from cp),
sw as (select *, decline and coalesce(lead(decline) over (order by step), false) as confirmed from fl)"""


@query(f"with {_SWEEP} select * from sw")
def sweep_index(spark: SparkSession, folder: str) -> DataFrame:
    """Each checkpoint against the baseline by the rules of stability, decline and its confirmation."""
    return evaluation.checkpoint_rows(_classes(spark, folder), "step", "lid")


@query(f"with {_SWEEP}, e as (select step, macro from mac where lid = 'en'), z as (select step, pc from mac where lid = 'zh')" + """
select min(step) filter (almost_unchanged) as first_unchanged, max(step) filter (almost_unchanged) as last_unchanged, min(step) filter (confirmed) as first_confirmed_decline,
  (select step from e join z using (step) where macro >= -1 order by pc desc, step limit 1) as best_step from sw""")
def sweep_choice(spark: SparkSession, folder: str) -> DataFrame:
    """First and last unchanged checkpoint, first confirmed decline, and the best step."""
    classes = _classes(spark, folder)
    of = lambda lang: classes.filter(F.col("lid") == lang).groupBy("step").agg(F.avg("candidate_percent").alias(f"{lang}_percent"), (F.avg("candidate_percent") - F.avg("baseline_percent")).alias(f"{lang}_pp"))
    return evaluation.chosen_steps(evaluation.checkpoint_rows(classes, "step", "lid"), of("en").join(of("zh"), "step"), "step", "en", "zh")


@query(f"with {_OUT}" + """, t as (select lid, label, 100.0::double * sum(b) / sum(total) as target_percent from cls where label <> 'backchannel' group by all),
a as (select lid, label, 100.0::double * sum(c) / sum(total) as percent from cls group by all)
select lid, label, percent, target_percent, percent - target_percent as away_pp, coalesce(abs(percent - target_percent) <= 1 + 1e-12, false) as within from a full join t using (lid, label)""")
def accuracy_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the labels by language and state against that of the official states, within a point."""
    per = _classes(spark, folder).groupBy("lid", "label").agg(F.sum("baseline_correct").alias("b"), F.sum("candidate_correct").alias("correct"), F.sum("total").alias("total"))
    targets = per.filter("label <> 'backchannel'").select("lid", "label", (F.lit(100.0) * F.col("b") / F.col("total")).alias("target_percent"))
    return evaluation.gated(per.select("lid", "label", "correct", "total"), targets, ["lid", "label"])


@query(f"with {_OUT}, s as (select source_id, any_value(metadata_member) as path from sources group by 1)" + """
select label, case when list_contains(string_split(path, '/'), 'json') then 'json' else 'other' end as subgroup, count(*) filter (after) as correct, count(*) as total, 100.0::double * count(*) filter (after) / count(*) as percent
from o left join s using (source_id) group by all""")
def subgroup_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy by state and by a component of the recording's path."""
    paths = table(spark, folder, "sources").groupBy("source_id").agg(F.first("metadata_member").alias("path"))
    return evaluation.subgroup_accuracy(_outcomes(spark, folder).join(paths, "source_id", "left"), "path", "json", F.col("label"), F.col("after"))


@query()
def class_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Resampled intervals of each class's difference, by the draws of Python's generator."""
    rows = _outcomes(spark, folder).withColumn("class", F.concat_ws("/", "lid", "label")).withColumn("delta", F.col("after").cast("int") - F.col("before").cast("int"))
    return evaluation.paired_intervals(rows, "class", "label", "label_id", "delta", F.lit(42), 2_000)


@query()
def language_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Resampled intervals of each language's mean of two classes."""
    rows = _outcomes(spark, folder).filter("label <> 'backchannel'").withColumn("delta", F.col("after").cast("int") - F.col("before").cast("int"))
    return evaluation.paired_intervals(rows, "lid", "label", "label_id", "delta", F.lit(4200), 2_000)


_HEADS = f"""{_OUT}, h as (select profile as run, month, label as head, avg(after::int)::double as accuracy from o group by all),
bs as (select run, head, arg_min(accuracy, month) as baseline from h group by all),
gr as (select bs.run, m.month, bs.head, baseline, coalesce(h.accuracy, 0) as accuracy from bs join (select distinct run, month from h) m using (run) left join h on h.run = bs.run and h.month = m.month and h.head = bs.head),
gt as (select run, month, round(max(baseline - accuracy), 9) as largest_drop, round(max(baseline - accuracy), 9) <= 0.05 as safe from gr group by all)"""


def _guard(spark: SparkSession, folder: str) -> DataFrame:
    heads = _outcomes(spark, folder).groupBy(F.col("profile").alias("run"), "month", F.col("label").alias("head")).agg(F.avg(F.col("after").cast("int")).alias("accuracy"))
    return evaluation.guard_trajectory(heads, "run", "month", "head")


@query(f"with {_HEADS} select * from gt")
def guard_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """Largest drop of a state's accuracy of each judge since its first month, and whether that is safe."""
    return _guard(spark, folder)


@query(f"with {_HEADS}" + """, f as (select profile as run, case profile when 'judge-a' then 1e-5::double when 'judge-b' then 2e-5 else 3e-5 end as peak_lr, 1 - avg(confidence) as objective from o group by 1),
r as (select run, arg_max(safe, month) as safe_end, max(month) filter (safe) as safe_step from gt group by 1),
j as (select *, safe_end and objective is not null as eligible from f join r using (run)), n as (select *, bool_or(eligible) over () as anyone from j),
p as (select *, row_number() over (order by eligible desc, case when anyone then objective else -epoch_us(safe_step) end nulls last, peak_lr) as place from n),
a as (select * from p where place = 1), b as (select * from p where place = 2)
select case when near and b.eligible and b.peak_lr < a.peak_lr then b.run else a.run end as run, case when near and b.eligible and b.peak_lr < a.peak_lr then b.peak_lr else a.peak_lr end as peak_lr,
  case when near and b.eligible then 'within 1 %: lower rate' when a.anyone then 'lowest objective' else 'longest safe' end as reason
from (select *, 1 as one from a) a left join (select *, 1 as one from b) b using (one), lateral (select coalesce((b.objective - a.objective) / a.objective <= 0.01, false) and a.anyone as near) l""")
def rate_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The judge to go on with, as a learning rate is chosen: guard, objective, and the lower rate of near ones."""
    rows = _outcomes(spark, folder)
    rate = F.when(F.col("profile") == "judge-a", 1e-5).when(F.col("profile") == "judge-b", 2e-5).otherwise(3e-5)
    finals = rows.groupBy(F.col("profile").alias("run"), rate.alias("peak_lr")).agg((1 - F.avg("confidence")).alias("objective"))
    steps = _guard(spark, folder).withColumn("month", F.unix_micros(F.col("month").cast("timestamp")))
    return evaluation.chosen_rate(steps, finals, "run", "month")


@query(f"with {_OUT}" + """, h as (select profile, label as head, avg(1 - confidence) as loss, count(confidence) as n from o group by all having count(confidence) > 0)
select profile, round(sum(case head when 'complete' then 0.4::double when 'incomplete' then 0.4 when 'backchannel' then 0.2 else 0 end * loss), 9) as objective, round(avg(loss), 9) as macro_loss, sum(n)::bigint as targets from h group by 1""")
def head_objective(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted objective over the states as heads, by judge; the loss of a label is its lack of confidence."""
    rows = _outcomes(spark, folder).groupBy("profile", "label", "lid").agg(F.avg(1 - F.col("confidence")).alias("loss"), F.count("confidence").alias("n")).filter("n > 0")
    weights = spark.createDataFrame(list(WEIGHTS.items()), "head string, weight double")
    return evaluation.weighted_heads(rows, ["profile"], "label", "loss", "n", weights)


@query("""with t as (select view_id, any_value(len(chunk_states)) as n, any_value(source_id) as source_id from timelines group by 1), v as (select view_id, any_value(chunk_count) as n, any_value(source_id) as source_id from target_views group by 1)
select fault, count(*) as views from (select case when t.view_id is null then 'untraced' when v.view_id is null then 'unlisted' when t.source_id is distinct from v.source_id then 'source_id' when t.n is distinct from v.n then 'chunks' end as fault from t full join v using (view_id)) where fault is not null group by 1""")
def trace_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Timelines as traces held against the list of views: absent ones, and those of another recording or length."""
    lines = table(spark, folder, "timelines").groupBy("view_id").agg(F.first(F.when(F.col("chunk_states").isNotNull(), F.size("chunk_states"))).cast("bigint").alias("chunks"), F.first("source_id").alias("source_id"))
    views = table(spark, folder, "target_views").groupBy("view_id").agg(F.first("chunk_count").alias("chunks"), F.first("source_id").alias("source_id"))
    return evaluation.trace_mismatches(lines, views, "view_id", ["source_id", "chunks"]).groupBy("fault").agg(F.count("*").alias("views"))
