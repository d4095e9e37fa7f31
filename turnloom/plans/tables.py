"""Queries of the engine's operators over the star-schema and event tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import checks, readout, stats
from turnloom.session import table
from turnloom.streaming import replay

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""with t as (select user_id, ts::date as day, epoch_us(ts) / 1e6::double as tm, epoch_us(ts::date::timestamp) / 1e6::double + 43200 as fin,
  case event_type when 'purchase' then 'complete' when 'signup' then 'incomplete' end as m from events)
select user_id, day, coalesce(arg_max(m, tm) filter (m is not null), 'none') as last, coalesce(arg_min(m, tm) filter (m is not null), 'none') as first,
  coalesce(arg_min(m, (abs(tm - fin), tm)) filter (m is not null), 'none') as closest,
  coalesce(arg_min(m, tm) filter (m is not null and tm + 1e-9 >= fin), 'none') as after, count(m) as terminals from t group by all""")
def trace_read_out(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and signups of a user's day as terminals, read at noon by the four rules."""
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1e6)
    day = F.to_date("ts")
    state = F.when(F.col("event_type") == "purchase", "speak").when(F.col("event_type") == "signup", "wait").otherwise("idle")
    steps = table(spark, folder, "events").select("user_id", day.alias("day"), state.alias("state"), seconds(F.col("ts")).alias("at"), (seconds(day.cast("timestamp_ntz")) + 43_200).alias("noon"))
    return readout.read_out(steps, ["user_id", "day"], "state", "at", "noon")


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) as weighted_loss, sum(l_quantity) as weight from lineitem group by 1")
def weighted_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Loss weighted by its number of targets."""
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("weighted_loss"), F.sum("l_quantity").alias("weight"))


@query("select event_type, sum(json_extract(props, '$.k')::bigint)::bigint as used, count(*) as calls from events group by 1")
def usage_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of a number in a JSON column by kind."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("used"), F.count("*").alias("calls"))


@query("""select case when try_cast(props as json) is null then 'unreadable' when json_extract(props, '$.k') is null then 'missing' when json_type(props, '$.k') not in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'type' else 'good' end as verdict, count(*) as rows from events group by 1""")
def json_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a JSON object holds a number where it should; a truth value is none."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    kind = F.schema_of_variant(value)
    verdict = F.when(F.try_parse_json("props").isNull(), "unreadable").when(value.isNull(), "missing").when(~kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), "type").otherwise("good")
    return table(spark, folder, "events").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


@query("""with w as (select date_trunc('week', ts)::date as week, avg((event_type = 'purchase')::int) as rate from events group by 1)
select week, rate < 0.2 as trigger, rate < 0.2 and coalesce(lead(rate < 0.2) over (order by week), false) as confirmed from w""")
def confirmed_declines(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks with a low share of purchases, confirmed by the next."""
    weeks = table(spark, folder, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.avg((F.col("event_type") == "purchase").cast("int")).alias("rate"))
    return stats.confirmed_declines(weeks, "week", "rate", 0.2).select("week", "trigger", "confirmed")


@query("select step, round(3e-4::double * least(1.0::double, step / 50.0::double) * sqrt(1000.0::double / (1000 + step)), 12) as rate from (select unnest(range(0, 301, 25)) as step)")
def learning_rates(spark: SparkSession, folder: str) -> DataFrame:
    step = F.col("id")
    return spark.range(0, 301, 25).select(step.alias("step"), F.round(stats.rewarmed_rate(3e-4, 1000, step, 50), 12).alias("rate"))


@query("""with g as (select unnest(range(0, 301, 25)) as step), r as (select (day(ts) * 10) as step, count(*) as events from events group by 1)
select g.step, coalesce(r.events, 0) as events, r.step is null as absent from g left join r on r.step = g.step""")
def step_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed grid of steps with what was measured at each, or that nothing was."""
    found = table(spark, folder, "events").groupBy((F.dayofmonth("ts").cast("bigint") * 10).alias("step")).agg(F.count("*").alias("events"))
    return spark.range(0, 301, 25).withColumnRenamed("id", "step").join(found, "step", "left").select("step", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), F.col("events").isNull().alias("absent"))


@query("""select 'orders without lines' as what, count(*) as keys from (select o_orderkey from orders except select l_orderkey from lineitem)
union all select 'lines without order', count(*) from (select distinct l_orderkey from lineitem except select o_orderkey from orders)
union all select 'repeated lines', count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)""")
def orphans_and_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and lines without the other, and lines that come again."""
    orders, lines = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")), table(spark, folder, "lineitem")
    only = checks.key_differences(orders, lines.select(F.col("l_orderkey").alias("k")), "k")
    count = lambda df, name: df.agg(F.count("*").alias("keys")).select(F.lit(name).alias("what"), "keys")
    return (
        count(only.filter("side = 'left'"), "orders without lines").unionByName(count(only.filter("side = 'right'"), "lines without order"))
        .unionByName(count(checks.repeated_keys(lines, ["l_orderkey", "l_linenumber"]), "repeated lines"))
    )


@query("""select coalesce(r_name, 'all') as region, coalesce(c_mktsegment, 'all') as segment, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, c_mktsegment)""")
def order_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A star join and a rollup: the dimension sides are left to the optimizer's size check."""
    orders, customer, nation, region = (table(spark, folder, n) for n in ("orders", "customer", "nation", "region"))
    star = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, nation.n_nationkey == customer.c_nationkey).join(region, region.r_regionkey == nation.n_regionkey)
    rolled = star.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rolled.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "orders", "total")


@query("""with i as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 1800000000 then 0 else 1 end as n from events),
s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as g from i)
select user_id, min(ts) as started, count(*) as events, round(sum(value), 6) as value from s group by user_id, g""")
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user less than half an hour apart are one session."""
    gap = F.session_window("ts", "1800.000001 seconds")
    return table(spark, folder, "events").groupBy("user_id", gap).agg(F.min("ts").alias("started"), F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value")).drop("session_window")


@query("select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as events, round(sum(value), 6) as value from events group by all")
def hourly_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling windows, with the same function that the stream uses."""
    return replay.tumbling(table(spark, folder, "events"), "ts", "1 hour", ["event_type"]).withColumnRenamed("start", "hour")


@query(ORACLE["hourly_activity"])
def streamed_hourly_activity(spark: SparkSession, folder: str) -> DataFrame:
    """The same, from a replay of the table as a stream."""
    return replay.replayed_tumbling(spark, f"{folder}/events.parquet", "ts", "1 hour", ["event_type"]).withColumnRenamed("start", "hour")


@query("select user_id, event_type, min(ts) as first_ts, count(*) - 1 as hits from events group by all")
def first_calls(spark: SparkSession, folder: str) -> DataFrame:
    """First event of each user and type, and how many follow."""
    from turnloom.operators import cache

    return cache.call_order(table(spark, folder, "events"), ["user_id", "event_type"], ["ts"])


@query("""select user_id, ts, event_type, value, round(avg(value) over w, 9) as mean_3, rank() over (partition by user_id order by value desc, ts) as place
from events window w as (partition by user_id order by ts rows between 2 preceding and current row)""")
def user_windows(spark: SparkSession, folder: str) -> DataFrame:
    """A moving mean and a rank per user."""
    along = Window.partitionBy("user_id")
    mean = F.round(F.avg("value").over(along.orderBy("ts").rowsBetween(-2, 0)), 9)
    place = F.rank().over(along.orderBy(F.desc("value"), "ts"))
    return table(spark, folder, "events").select("user_id", "ts", "event_type", "value", mean.alias("mean_3"), place.alias("place"))
