"""Cutting oversized sequences at natural boundaries, with overlap.

A sequence is first turned into its *shape*: one character per unit of length,
control tokens becoming marks by the strength of the boundary they make, all
else ``x``. A piece is then one regular-expression extraction with a bounded
quantifier: the alternatives, strongest boundary first, take as much as the
limit leaves, and the last takes any character. The quantified atom is a single
character, so matching is a loop and long texts can't exhaust the stack.

Where a piece ends at the end of a group, the next one looks back to the
starts of the last two groups (by array functions over the group lengths) and
begins there if these, with the group to come, fit; else with one, else none.

The work grows with the length of a sequence: shape and group ends are arrays
made once, and each piece takes no more of them than the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prefix of a sequence, the states that end a group, and what a control token looks like.
PREFIX = ("<|task_duplex_predict|>", "<|punctuation_off|>")
STATES = ("user_idle", "user_nonidle", "user_complete", "user_incomplete", "user_backchannel")
CONTROL = r"<\|[^<|>]+\|>"
LIMIT = 1_500

#: Marks of a shape, by strength: end of a group, end of its text, other control token, space or punctuation.
GROUP, SENTENCE, OTHER, PAUSE = "\u0001", "\u0002", "\u0003", "\u0004"
MARKS = GROUP + SENTENCE + OTHER + PAUSE
#: Columns added.
RESULTS = ("piece_no", "piece", "piece_text", "piece_length")


def body(sequence: Column) -> Column:
    """The sequence without its prefix (either token of which may be missing)."""
    first, second = (x.replace("|", r"\|") for x in PREFIX)
    return F.regexp_replace(sequence, f"^(?:{first})?(?:{second})?", "")


def unit_length(sequence: Column) -> Column:
    """Number of control tokens plus all other code points; null for null."""
    return F.length(F.regexp_replace(sequence, CONTROL, "x"))


def shape(text: Column) -> Column:
    """One ASCII character per unit of length; the last one always ends a group."""
    out = F.translate(text, MARKS, "x" * len(MARKS))
    out = F.regexp_replace(out, rf"<\|(?:{'|'.join(STATES)})\|>", GROUP)
    out = F.regexp_replace(out, r"<\|end_of_sentence\|>", SENTENCE)
    out = F.regexp_replace(out, CONTROL, OTHER)
    out = F.regexp_replace(out, r"[\s\p{P}]", PAUSE)
    out = F.regexp_replace(out, f"[^{MARKS}]", "x")
    return F.when(out == "", out).otherwise(F.concat(out.substr(F.lit(1), F.length(out) - 1), F.lit(GROUP)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(marks: Column, room: int) -> Column:
    """Pieces of a sequence of which ``marks`` is the shape: a fold, one extraction a step."""
    half = room // 2
    inner = "|".join(f".{{{half},{room - 1}}}{mark}" for mark in (SENTENCE, OTHER, PAUSE))
    pattern = f"^(?s:.{{0,{room - 1}}}{GROUP}|{inner}|.{{1,{room}}})"

    def fold(chars: Column, bounds: Column) -> Column:
        """``bounds``: 0, then the end of each group; both are bound to variables, so no step makes them again."""
        def step(acc: Column, _: Column) -> Column:
            pos, done, whole = acc["pos"], acc["done"], acc["whole"]

            def over(back: int) -> Column:  # units looked back over; they must fit together with the group to come
                fits = whole & (done >= back) & (F.get(bounds, done + 1) - F.get(bounds, done - back) <= room)
                return F.when(fits, F.struct(F.lit(back).alias("back"), (pos - 1 - F.get(bounds, done - back)).alias("over")))

            def grow(look: Column) -> Column:
                ahead = F.array_join(F.slice(chars, pos, F.lit(room) - look["over"]), "")
                took = F.length(F.regexp_extract(ahead, pattern, 0))
                # a group has at least one unit, so a piece passes no more than ``room`` ends
                passed = lambda end: done + F.size(F.filter(F.slice(bounds, done + 2, F.lit(room)), lambda x: x <= end))
                return _let(pos + took - 1, lambda end: _let(passed(end), lambda n: after(look, end, n)))

            def after(look: Column, end: Column, passed: Column) -> Column:
                at_group = F.get(bounds, passed) == end
                piece = F.struct(
                    (pos - look["over"]).alias("start"), (end - pos + 1 + look["over"]).alias("len"),
                    (done - look["back"]).alias("first"), (passed + F.when(at_group, 0).otherwise(1)).alias("last"),
                    (~whole | ~at_group).alias("inside"),
                )
                return F.struct((end + 1).alias("pos"), passed.alias("done"), at_group.alias("whole"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))

            none = F.struct(F.lit(0).alias("back"), F.lit(0).alias("over"))
            return F.when(pos > F.size(chars), acc).otherwise(_let(F.coalesce(over(2), over(1), none), grow))

        empty = F.array().cast("array<struct<start:int,len:int,first:int,last:int,inside:boolean>>")
        start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("done"), F.lit(True).alias("whole"), empty.alias("pieces"))
        # a step covers a group, or half the room within one; a group too long takes one more
        steps = F.sequence(F.lit(1), F.size(bounds) + F.floor(F.size(chars) / F.lit(max(1, half))).cast("int") + 1)
        return F.aggregate(steps, start, step, lambda acc: acc["pieces"])

    ends = lambda chars: F.concat(F.array(F.lit(0)), F.array_compact(F.transform(chars, lambda c, i: F.when(c == GROUP, i + 1))))
    return _let(F.split(marks, ""), lambda chars: _let(ends(chars), lambda bounds: fold(chars, bounds)))


def _long(rows: DataFrame, sequence: str, limit: int) -> tuple[DataFrame, list[str]]:
    kept = [c for c in rows.columns if c not in RESULTS]
    return rows.filter(unit_length(F.col(sequence)) > limit), kept


def cut_points(rows: DataFrame, sequence: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose sequence is over ``limit``, once per piece, with ``piece``: where it lies.

    ``piece`` is ``struct<start, len, first, last, inside>``: the first unit (from
    1) and number of units of the body it takes, its groups ``[first, last)``, and
    whether it begins or ends inside a group; ``piece_no`` counts from 0. A piece
    with the prefix is at most ``limit`` long. Groups are cut only when one with
    the prefix is over the limit, then at the strongest boundary in the second
    half of the room. What follows the last group's end counts as a group. Null
    and empty sequences, and those within the limit, give no row. Input columns
    are kept, but for those named like a result; repeated rows stay repeated.
    """
    long, kept = _long(rows, sequence, limit)
    return long.select(*kept, F.posexplode(_pieces(shape(body(F.col(sequence))), limit - len(PREFIX))).alias("piece_no", "piece"))


def split_sequences(rows: DataFrame, sequence: str, limit: int = LIMIT) -> DataFrame:
    """The pieces of :func:`cut_points` with their text in ``piece_text`` and its ``piece_length``."""
    long, kept = _long(rows, sequence, limit)
    units = F.regexp_extract_all(body(F.col(sequence)), F.lit(rf"(?s){CONTROL}|."), F.lit(0))
    pieces = _pieces(shape(body(F.col(sequence))), limit - len(PREFIX))
    text = lambda units, p: F.concat(F.lit("".join(PREFIX)), F.array_join(F.slice(units, p["start"], p["len"]), ""))
    cut = _let(units, lambda units: F.transform(pieces, lambda p: F.struct(p.alias("piece"), text(units, p).alias("piece_text"))))
    each = long.select(*kept, F.posexplode(cut).alias("piece_no", "x"))
    return each.select(*kept, "piece_no", "x.piece", "x.piece_text", (F.col("x.piece.len") + len(PREFIX)).alias("piece_length"))
