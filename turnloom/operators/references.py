"""References to records that are missing, deleted or not yet there, by bitmap algebra.

Keys are dictionary-encoded as integers: a fixed number of hash buckets, and
the rank of the key in its bucket. That needs no state outside the plan, gives
the same number however often a lost task is run again, and makes the numbers
dense, so that bitmaps over them are small. A bitmap is a set of 64-bit words,
one row per (kind, word, period) with a bit set; empty words are not stored.
Words are formed by a combinable ``bit_or``.

Per period, referring keys AND NOT the keys whose target is there during the
whole period leave the suspects; AND NOT the keys that exist at all tells the
missing ones. Surviving bits are decoded through the dictionary. Only the rows
of suspects that do exist are then held against exact times, in a sorted pass per
(key, second) with a carry from earlier seconds and days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut

#: Hash buckets of the dictionary: a bucket's keys are ranked in one sorted task.
BUCKETS = 4096
#: Room for ranks of one bucket in the integer code.
SPAN = 2**32
FOREVER = 2**62


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _dictionary(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(kind, key) -> code, with the months it is referred to in and what bitmaps need of its target."""
    starts_month = F.date_trunc("month", F.col("arrived")) == F.col("arrived")
    full_from = _month(F.col("arrived")) + F.when(starts_month, 0).otherwise(1)
    gone = F.col("deleted").isNotNull()
    none = F.lit(None).cast("int")
    seen = refs.select("kind", "key", _month(F.col("at")).alias("month"), none.alias("open"), none.alias("low"), none.alias("high"), F.lit(False).alias("there"), F.lit(None).cast("bigint").alias("first"))
    have = parents.select(
        "kind", "key", none.alias("month"),
        F.when(~gone, full_from).alias("open"),
        F.when(gone, full_from).alias("low"), F.when(gone, _month(F.col("deleted"))).alias("high"),
        F.lit(True).alias("there"), _micros(F.col("arrived")).alias("first"),
    )
    spans = F.when(F.col("high") > F.col("low"), F.struct("low", "high"))
    keys = seen.unionByName(have).groupBy("kind", "key").agg(
        F.collect_set("month").alias("months"), F.min("open").alias("open"), F.collect_set(spans).alias("spans"),
        F.max("there").alias("there"), F.min("first").alias("first"),
    )
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("key")) - 1
    return keys.withColumn("code", F.col("bucket") * SPAN + rank).drop("bucket")


def _suspects(coded: DataFrame) -> DataFrame:
    """Bits of references AND NOT targets: (kind, code, month, missing)."""
    coded = coded.withColumn("bit", F.expr("shiftleft(1L, cast(code & 63 as int))")).withColumn("word", F.expr("shiftright(code, 6)"))
    planes = F.expr("""
        concat(
          transform(months, m -> named_struct('month', m, 'refs', bit, 'opened', 0L, 'closed', 0L, 'there', 0L)),
          if(there, array(named_struct('month', coalesce(open, 1 << 30), 'refs', 0L, 'opened', if(open is null, 0L, bit), 'closed', 0L, 'there', bit)), array()),
          flatten(transform(spans, s -> transform(sequence(s.low, s.high - 1),
            m -> named_struct('month', m, 'refs', 0L, 'opened', 0L, 'closed', bit, 'there', 0L)))))
    """)
    planes = coded.select("kind", "word", F.inline(planes))
    words = planes.groupBy("kind", "word", "month").agg(*[F.bit_or(c).alias(c) for c in ("refs", "opened", "closed", "there")])
    of_word = Window.partitionBy("kind", "word")
    so_far = of_word.orderBy("month").rangeBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("opened", F.bit_or("opened").over(so_far)).withColumn("there", F.bit_or("there").over(of_word))
    left = words.select(
        "kind", "word", "month",
        F.expr("refs & ~(opened | closed)").alias("left"), F.expr("refs & ~there").alias("missing"),
    ).filter("left <> 0")
    bits = left.select("*", F.explode(F.expr("sequence(0, 63)")).alias("i")).filter("(shiftright(left, i) & 1) = 1")
    return bits.select("kind", F.expr("word * 64 + i").alias("code"), "month", F.expr("(shiftright(missing, i) & 1) = 1").alias("missing"))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference whose target is not there at the time of the reference.

    ``refs``: ``kind`` (which parent table), ``field``, ``row_key``, ``key``
    and ``at``; ``parents``: ``kind``, ``key``, ``arrived``, ``deleted``, a row
    per delivery. Times are timestamps without zone, keys already cleaned.
    A target is there at ``t`` if a delivery has ``arrived <= t`` and
    ``deleted`` null or ``> t``. Returns distinct rows ``field``, ``row_key``,
    ``key``, ``reason`` (``missing``, ``late``, ``deleted``) and ``month``
    (``yyyy-MM`` of ``at``).

    Null keys are no reference; a reference without a time can't be placed in
    a period and gives no row. A delivery without an arrival is a row of its
    key, yet was never there: with no other one, the reason is ``late``. Other
    columns are ignored; an empty parent table makes all references missing.
    """
    refs = refs.filter("key is not null and at is not null").select("kind", "field", "row_key", "key", "at")
    parents = parents.filter("key is not null").select("kind", "key", "arrived", "deleted")
    coded = _dictionary(refs, parents)
    named = _suspects(coded).join(coded.select("kind", "code", "key", "first"), ["kind", "code"]).select("kind", "key", "month", "missing", "first")
    hits = refs.withColumn("month", _month(F.col("at"))).join(named, ["kind", "key", "month"])
    hits = cut(hits.withColumn("t", _micros(F.col("at"))))
    columns = ["field", "row_key", "key", "reason", F.date_format(F.col("at"), "yyyy-MM").alias("month")]

    sure = F.when(F.col("missing"), "missing").when(F.coalesce(F.col("first"), F.lit(FOREVER)) > F.col("t"), "late")
    hits = hits.withColumn("reason", sure)
    decided = hits.filter("reason is not null").select(*columns)

    # what is left exists and had arrived: was it deleted at that very time?
    open_ = hits.filter("reason is null").drop("reason", "missing", "first", "month")
    place = [F.expr("t div 86400000000").alias("day"), F.expr("t div 1000000").alias("second")]
    asked = open_.select("kind", "key", "t").distinct().select("kind", "key", "t", *place, F.lit(1).alias("ask"), F.lit(None).cast("bigint").alias("until"))
    lives = parents.filter("arrived is not null").join(asked.select("kind", "key"), ["kind", "key"], "left_semi")
    lives = lives.groupBy("kind", "key", _micros(F.col("arrived")).alias("t")).agg(F.max(F.coalesce(_micros(F.col("deleted")), F.lit(FOREVER))).alias("until"))
    lives = lives.select("kind", "key", "t", *place, F.lit(0).alias("ask"), "until")
    line = asked.unionByName(lives)
    # what earlier seconds of the day and earlier days leave behind: no key is sorted beyond a second's, a day's or its days' rows
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seconds = line.groupBy("kind", "key", "day", "second").agg(F.max("until").alias("until"))
    days = seconds.groupBy("kind", "key", "day").agg(F.max("until").alias("until"))
    days = days.select("kind", "key", "day", F.max("until").over(earlier(["kind", "key"], "day")).alias("far"))
    near = F.max("until").over(earlier(["kind", "key", "day"], "second")).alias("near")
    carried = seconds.select("kind", "key", "day", "second", near).join(days, ["kind", "key", "day"]).select("kind", "key", "second", F.greatest("near", "far").alias("carry"))
    now = Window.partitionBy("kind", "key", "second").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("until", F.max("until").over(now)).filter("ask = 1").join(carried, ["kind", "key", "second"])
    dead = line.filter("coalesce(greatest(until, carry), 0) <= t").select("kind", "key", "t")
    deleted = open_.join(dead, ["kind", "key", "t"]).withColumn("reason", F.lit("deleted")).select(*columns)
    return decided.unionByName(deleted).distinct()
