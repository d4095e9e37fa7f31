"""Label requests of recordings, and finalising events with the labels that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.bounds import chunk_range
from turnloom.operators import labels
from turnloom.session import cut

#: Tokens a request may ask for, least, most and by event.
LEAST_TOKENS, MOST_TOKENS, EVENT_TOKENS = 1024, 8192, 160
#: Chunks in a block of a view.
BLOCK = 256


def timed_places(rows: DataFrame, key: str, at: str, order: list[str], span: float = 600_000.0) -> DataFrame:
    """Rows with ``place``, from 0, in the order of ``at`` and then ``order`` within their key.

    A key is cut into spans of ``at``; the rows before a span are counted in a
    table of one row per span, so a hot key is not sorted in one task. Rows without
    a finite time come last, in a span of their own.
    """
    finite = F.abs(F.col(at)) < float("inf")  # NaN compares as larger
    spanned = rows.withColumn("_span", F.when(finite, F.floor(F.least(F.greatest(F.col(at) / span, F.lit(-(2.0**60))), F.lit(2.0**60)))).otherwise(F.lit(2**62)))
    sizes = spanned.groupBy(key, "_span").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_span").alias("_s"), earlier.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_span").orderBy(F.when(finite, F.col(at)).asc_nulls_last(), *order)) - 1
    placed = spanned.withColumn("_inside", inside).join(sizes, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_span") == F.col("_s")))
    return placed.withColumn("place", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_span", "_key", "_s", "_before", "_inside")


def request_faults(events: DataFrame, wanted: DataFrame, views: DataFrame) -> DataFrame:
    """What forbids a request: ``wanted`` ids that are repeated or no event of their source, events of a track without a view.

    ``events``: ``event_id``, ``source_id``, ``channel``; ``wanted``: ``event_id``,
    ``source_id``; ``views``: ``source_id``, ``channel``. Returns ``source_id``,
    ``event_id``, ``fault``.
    """
    counted = wanted.groupBy("source_id", "event_id").agg(F.count("*").alias("n"))
    known = events.select("source_id", "event_id").distinct().withColumn("known", F.lit(True))
    asked = counted.join(known, ["source_id", "event_id"], "left").select("source_id", "event_id", F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated").alias("fault"))
    of_sources = events.join(wanted.select("source_id").distinct(), "source_id", "left_semi")
    viewless = of_sources.join(views.select("source_id", "channel"), ["source_id", "channel"], "left_anti").select("source_id", "event_id", F.lit("no view").alias("fault"))
    return asked.filter("fault is not null").unionByName(viewless.distinct())


def request_sizes(wanted: DataFrame) -> DataFrame:
    """Per source the number of events to label, an order-free digest of their ids, and the tokens the answer may take."""
    bits = F.conv(F.substring(F.sha2(F.col("event_id"), 256), 1, 12), 16, 10).cast("bigint")
    rows = wanted.select("source_id", "event_id").distinct().groupBy("source_id").agg(F.count("*").alias("events"), F.sum(bits.cast("decimal(20,0)")).cast("string").alias("digest"))
    return rows.withColumn("max_tokens", F.least(F.lit(MOST_TOKENS), F.greatest(F.lit(LEAST_TOKENS), F.col("events") * EVENT_TOKENS)))


def response_rows(responses: DataFrame, requests: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Labels of the responses that match a request, and faults.

    ``responses``: ``signature``, ``model``, ``labels`` (array of structs
    ``event_id``, ``state``, ``confidence``, ``reason``); ``requests``:
    ``signature``, ``event_ids``. Labels come out one a row with their ``place`` in
    the order asked for. Faults: ``signature`` and ``fault``: ``unknown`` signature,
    ``model`` other than the one asked, what :func:`labels.response_faults` finds,
    and ``answered twice`` for events labelled in several responses.
    """
    joined = responses.join(requests.select("signature", F.col("event_ids").alias("asked"), F.lit(True).alias("known")), "signature", "left")
    found = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown"), F.when(~F.col("model").eqNullSafe(F.lit(model)), "model")))
    found = F.concat(found, F.coalesce(labels.response_faults(F.col("asked"), F.col("labels")), F.array().cast("array<string>")))
    judged = joined.withColumn("found", found)
    good = judged.filter(F.size("found") == 0)
    rows = good.select("signature", "asked", F.inline("labels")).withColumn("place", F.array_position("asked", F.col("event_id")) - 1).drop("asked")
    twice = rows.groupBy("event_id").agg(F.count("*").alias("n"), F.min("signature").alias("signature")).filter("n > 1").select("signature", F.lit("answered twice").alias("fault"))
    return rows, judged.select("signature", F.explode("found").alias("fault")).unionByName(twice)


def finalised(events: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with ``final_state``, ``state_label_source`` and ``quality``, and faults.

    ``events``: ``event_id``, ``official_state``; ``given``: ``event_id``,
    ``label_state``, a row per label. Faults (``event_id``, ``fault``): a label
    ``duplicate`` for its event, of an ``unknown`` event, of no known ``state``; an
    event without official state and label (``missing``), or of an ``unsupported``
    official state. An event with several labels takes the least state.
    """
    counted = given.groupBy("event_id").agg(F.count("*").alias("n"), F.min("label_state").alias("label_state"), F.bool_and(F.coalesce(F.col("label_state").isin("complete", "incomplete", "backchannel"), F.lit(False))).alias("good"))
    both = events.select("event_id", "official_state", F.lit(True).alias("known")).join(counted, "event_id", "full_outer")
    official = F.col("official_state")
    supported = official.isNull() | official.isin(*labels.EVENT_STATES)
    fault = F.array_compact(F.array(
        F.when(F.col("n") > 1, "duplicate"), F.when(F.col("known").isNull(), "unknown"), F.when(~F.col("good"), "state"),
        F.when(F.col("known") & official.isNull() & F.col("n").isNull(), "missing"), F.when(~supported, "unsupported"),
    ))
    state, origin = labels.precedence(official, F.col("label_state"))
    quality = F.when(origin == "official", "official").when(origin == "wait_as_complete", "mapped").when(origin == "substitute", "pseudolabel")
    rows = both.filter("known").select("event_id", state.alias("final_state"), origin.alias("state_label_source"), quality.alias("quality"))
    return rows, both.select("event_id", F.explode(fault).alias("fault"))


def _blocks(views: DataFrame, arrays: list[str], block: int) -> DataFrame:
    """A row per ``block`` chunks of a view: its other columns, the number of ``blocks``, this one's place and its part of each array.

    Elements are fetched by place, as a slice copies the whole array each time.
    The last part is filled up with nulls; null arrays stay null, and a view without chunks has one block.
    """
    longest = F.greatest(F.lit(0), *[F.coalesce(F.size(a), F.lit(0)) for a in arrays])
    blocks = F.greatest(F.ceil(longest / block), F.lit(1)).cast("int")

    def part(a: str, k: Column) -> Column:
        return F.when(F.col(a).isNotNull(), F.transform(F.sequence(k * block, k * block + (block - 1)), lambda i: F.get(F.col(a), i)))

    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(k.alias("block"), *[part(a, k).alias(a) for a in arrays]))
    return views.select(*[c for c in views.columns if c not in arrays], blocks.alias("blocks"), F.inline(parts))


def relations(events: DataFrame, views: DataFrame, arrays: list[str], block: int = BLOCK) -> DataFrame:
    """Events with what their chunk range covers of the view of their track, as :func:`grid.slice_sums`, and ``chunk_start`` and ``chunk_stop``.

    ``events``: ``source_id``, ``channel``, BIGINT ``start`` and ``stop`` in ms, which
    don't come out, and any other columns; together they tell a row. ``views``:
    ``view_id``, ``source_id``, ``channel``, ``chunk_count`` and the ``arrays`` target,
    other, overlap and counts. A view is cut into blocks, written once to the shared
    folder, and an event meets the blocks that it touches only: a long view's arrays
    are never copied for each of its events. A range of no chunks meets one block.
    """
    blocks = cut(_blocks(views.select("view_id", "source_id", "channel", "chunk_count", *arrays), arrays, block))
    heads = blocks.filter("block = 0").select("view_id", "source_id", "channel", "chunk_count", "blocks")
    lo, hi = chunk_range(F.col("start").cast("double"), F.col("stop").cast("double"), F.col("chunk_count"))
    own = [c for c in events.columns if c not in ("start", "stop")]
    ranged = events.join(heads, ["source_id", "channel"]).select(*own, "view_id", "blocks", lo.alias("chunk_start"), hi.alias("chunk_stop"))
    near = lambda chunk: F.least(F.floor(chunk / block), F.col("blocks") - 1).cast("int")
    touched = F.sequence(near(F.col("chunk_start")), near(F.greatest(F.col("chunk_stop") - 1, F.col("chunk_start"))))
    kept = [*own, "chunk_start", "chunk_stop"]
    pieces = ranged.select(*kept, F.col("view_id").alias("_view"), F.explode(touched).alias("_block"))

    # merged with pieces first, as a block that meets its pieces is copied for all of them at once; arrays compress so well that sizes on disk mislead the optimizer
    met = pieces.join(blocks.select("view_id", "block", *arrays).hint("merge"), F.col("_view").eqNullSafe(F.col("view_id")) & (F.col("_block") == F.col("block")))
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("block") * F.lit(block).cast("bigint"), F.lit(0)), F.lit(block)).cast("int")
    start, size = inside("chunk_start"), inside("chunk_stop") - inside("chunk_start")
    part = lambda a: F.slice(F.col(a), start + 1, size)
    names = ["target_chunks", "other_chunks", "overlap_chunks"]
    counted = [F.size(F.filter(part(a), lambda x: x)).alias(n) for a, n in zip(arrays, names)]
    summed = met.select(*kept, "_view", *counted, F.array_max(part(arrays[3])).alias("most_other")).groupBy(*kept, "_view")
    sums = summed.agg(*[F.sum(n).cast("int").alias(n) for n in names], F.coalesce(F.max("most_other"), F.lit(0)).alias("most_other"))
    return sums.select(*kept, (F.col("chunk_stop") - F.col("chunk_start")).cast("int").alias("chunk_span"), *names, "most_other")
