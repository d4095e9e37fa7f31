"""Evaluation passages in training text: shared character q-grams in diagonal bands, then banded alignment.

Texts become sequences of units (a Han character, or a run of other letters and
digits) and are written in *canonical* form: a blank before, between and after
the units. A passage is ``window`` consecutive units of an item with the blanks
around them. A document leaks the item if a passage occurs in its canonical text
with at most ``edits`` characters changed, dropped or added; without edits that
is the same as having the units in common.

The q-gram lemma: with ``k`` edits a passage of ``L`` characters shares at least
``L + 1 - q * (k + 1)`` q-grams with the place where it occurs, on diagonals
(place in the document minus place in the item) at most ``k`` apart. It is used
three times, each time losing no occurrence:

* One scan of the documents keeps the regions where it could hold at all: runs of
  ``window - k`` units of which at most ``k * (q + 1)`` q-grams are none of the
  items'. These are told by a bitmap of fixed size, the only thing broadcast.
* Of at most ``k + 1`` intact stretches of an occurrence the longest has a known
  number of q-grams, so both sides pick the same least hash in it: regions and
  items that share a picked hash are candidates, by an ordinary join.
* For each candidate pair the shared q-grams are counted per passage in
  overlapping diagonal bands; bands that reach the bound are aligned.

Regions and items of equal text are treated once, and documents and item ids join
their results in the end: a passage copied into a third of all documents, or
held by many items, is looked at once. Neither side goes through the driver.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.batches import parts as parts_of
from turnloom.session import cut

#: Units in common that make a case.
WINDOW = 24
#: Slots of the table of the items' q-grams, as a power of two: 8 MB. A fuller table keeps more regions and loses none.
BITS = 23
#: Documents and pairs worked on together.
DOCUMENTS, PAIRS = 500, 200

_UNIT = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> list[str]:
    """Units of a text after NFKC and lower case; none for null, empty and sign-only texts."""
    if not text:
        return []
    return _UNIT.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


@dataclass(frozen=True)
class Bounds:
    """What the lemma gives for a number of edits. The shortest passage has units of one character."""

    window: int
    edits: int

    @property
    def q(self) -> int:
        return max(1, (2 * self.window + 1) // (2 * self.edits + 2))

    def shared(self, length):
        """Least number of q-grams that a passage of so many characters shares with an occurrence."""
        return length + 1 - self.q * (self.edits + 1)

    @property
    def pick(self) -> int:
        """Consecutive q-grams of which the least hash is picked: no more than the longest intact stretch has."""
        return max(1, -(-self.shared(2 * self.window + 1) // (self.edits + 1)))

    @property
    def lost(self) -> int:
        """Most q-grams of an occurrence that the item may not have."""
        return self.edits * (self.q + 1)

    @property
    def margin(self) -> int:
        """Units by which an occurrence may go beyond the complete ones within it."""
        return 2 * self.edits + 2 if self.edits else 0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(values: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, joined from those of half the size."""
    mixed = (values + np.uint64(1)) * _STEP
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out, width = mixed, 1
    for bit in bin(q)[3:]:
        factor = np.uint64(pow(int(_STEP), width, 2**64))
        out = out[: max(0, len(out) - width)] * factor + out[width:]
        width *= 2
        if bit == "1":
            n = max(0, len(mixed) - width)
            out = out[:n] * _STEP + mixed[width : width + n]
            width += 1
    return out ^ (out >> np.uint64(32))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)


def _picked(hashes: np.ndarray, over: int) -> np.ndarray:
    """The distinct hashes that are least among ``over`` neighbours."""
    if len(hashes) <= over:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, over).min(1))


def _spans(keep: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of units covered by the windows of ``size`` units that are kept."""
    out: list[tuple[int, int]] = []
    for at in np.flatnonzero(keep).tolist():
        if out and at <= out[-1][1] - size + 1:
            out[-1] = (out[-1][0], at + size)
        else:
            out.append((at, at + size))
    return out


def _varied(us: list[str], size: int) -> list[list[str]]:
    """The parts of a text that hold each of its windows of ``size`` units once, so that repetition costs nothing."""
    if len(us) <= size:
        return [us]
    windows = _grams(np.array([hash(u) & 0x7FFFFFFFFFFFFFFF for u in us], np.uint64), size)
    first = np.zeros(len(windows), bool)
    first[np.unique(windows, return_index=True)[1]] = True
    return [us[a:b] for a, b in _spans(first, size)]


def _canonical(us: list[str]) -> str:
    return f" {' '.join(us)} "


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _described(part: str, bounds: Bounds) -> tuple[str, str, list[int]]:
    """Id, text and picked hashes (as signed integers) of a canonical text."""
    return _digest(part), part, _picked(_grams(_points(part), bounds.q), bounds.pick).view(np.int64).tolist()


def _table(kind: str, ids: pa.Array, rows: list[tuple[int, tuple[str, str, list[int]]]]) -> pa.RecordBatch:
    take = pa.array([r for r, _ in rows], pa.int64())
    parts = [pa.array([x[j] for _, x in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays([ids.take(take), *parts], names=[kind, "part", "body", "picked"])


def _parts_of_items(items: DataFrame, item: str, text: str, bounds: Bounds) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                us = units(t)
                if len(us) >= bounds.window:
                    rows += [(i, _described(_canonical(p), bounds)) for p in _varied(us, bounds.window)]
            yield _table("i", batch.column(0), rows)

    kind = items.schema[item].dataType.simpleString()
    return items.select(item, text).filter(f"`{item}` is not null and length(`{text}`) > 0").mapInArrow(run, f"item {kind}, part string, body string, picked array<bigint>")


def _bitmap(parts: DataFrame, bounds: Bounds) -> np.ndarray:
    """Which slots the items' q-grams have. Tasks and a combinable ``bit_or`` put it together; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen[_slot(_grams(_points(body), bounds.q))] = True
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at])], names=["at", "word"])

    words = np.zeros((1 << BITS) // 64, np.int64)
    found = parts.select("body").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _regions(texts: list[str | None], known: np.ndarray, bounds: Bounds) -> list[tuple[int, tuple[str, str, list[int]]]]:
    """(row, description) of the regions of a batch of documents that may hold an occurrence."""
    size, q = bounds.window - bounds.edits, bounds.q
    rows, lists, bodies = [], [], []
    for row, text in enumerate(texts):
        us = units(text)
        if len(us) >= max(1, size):
            rows.append(row)
            lists.append(us)
            bodies.append(_canonical(us))
    if not rows:
        return []
    values = _points("".join(bodies))  # a text ends and the next begins with a blank: no window crosses
    missing = np.r_[0, np.cumsum(~known[_slot(_grams(values, q))])]
    blanks = np.flatnonzero(values == 32)
    ends = np.cumsum([len(b) for b in bodies])
    doc = np.searchsorted(ends, blanks, "right")
    # a window of units runs from one blank to another, both of the same text
    low, high = blanks[: len(blanks) - size], blanks[size:]
    good = doc[: len(low)] == doc[size:]
    last = np.clip(high + 2 - q, 0, len(missing) - 1)  # q-grams that begin before this end within the window
    few = missing[np.maximum(last, low)] - missing[low] <= bounds.lost
    number = np.arange(len(blanks)) - np.searchsorted(doc, doc, "left")
    at = np.flatnonzero(good & few)
    out = []
    for d in np.unique(doc[at]).tolist():
        us = lists[d]
        keep = np.zeros(len(us) - size + 1, bool)
        keep[number[at[doc[at] == d]]] = True
        wide: list[tuple[int, int]] = []
        for a, b in _spans(keep, size):
            a, b = max(0, a - bounds.margin), min(len(us), b + bounds.margin)
            if wide and a <= wide[-1][1]:
                wide[-1] = (wide[-1][0], b)
            else:
                wide.append((a, b))
        for a, b in wide:
            out += [(rows[d], _described(_canonical(p), bounds)) for p in _varied(us[a:b], bounds.window + bounds.margin)]
    return out


def _aligned(patterns: list[np.ndarray], texts: list[np.ndarray], edits: int) -> np.ndarray:
    """Least edits with which each pattern occurs in its text, which starts at the lowest diagonal of its band.

    All rows at once, in a band of ``4 * edits + 1`` diagonals; the start in the
    text is free. More than ``edits`` if none is so near.
    """
    band = 4 * edits + 1
    sizes = np.array([len(p) for p in patterns])
    w = int(sizes.max())
    shape = np.full((len(patterns), w), 2**32, np.int64)
    against = np.full((len(patterns), w + band - 1), 2**33, np.int64)
    for i, (p, t) in enumerate(zip(patterns, texts)):
        shape[i, : len(p)] = p
        against[i, : len(t)] = t
    cost, best = np.zeros((len(patterns), band), np.int32), np.full(len(patterns), edits + 1, np.int32)
    for i in range(w):
        now = cost + (shape[:, i, None] != against[:, i : i + band])
        np.minimum(now[:, :-1], cost[:, 1:] + 1, out=now[:, :-1])  # a character of the pattern dropped
        for k in range(1, band):
            np.minimum(now[:, k], now[:, k - 1] + 1, out=now[:, k])  # one of the text added
        cost = now
        over = sizes == i + 1
        best[over] = np.minimum(cost[over].min(1), edits + 1)
    return best


def occurrence(item: str, region: str, bounds: Bounds) -> int | None:
    """Least edits with which a passage of a canonical item text occurs in a region; None if over the budget."""
    a, b, q, e = _points(item), _points(region), bounds.q, bounds.edits
    ours, theirs = _grams(a, q), _grams(b, q)
    order = np.argsort(ours, kind="stable")
    lo, hi = np.searchsorted(ours[order], theirs, "left"), np.searchsorted(ours[order], theirs, "right")
    many = hi - lo
    entry = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.empty(0, np.int64)
    place = order[entry]
    diagonal = np.repeat(np.arange(len(theirs)), many) - place
    # overlapping bands: 2e + 1 diagonals wide, e + 1 apart; each hit is in one or two
    band = diagonal // (e + 1)
    bands, places = [band], [place]
    if e:
        lower = diagonal - (band - 1) * (e + 1) <= 2 * e
        bands.append(band[lower] - 1)
        places.append(place[lower])
    blanks = np.flatnonzero(a == 32)
    first, end = blanks[: -bounds.window], blanks[bounds.window :] + 1  # of the passages
    least = bounds.shared(end - first)
    bands, places = np.concatenate(bands), np.concatenate(places)
    best = None
    numbers, counts = np.unique(bands, return_counts=True)
    for number in numbers[counts >= max(1, least.min())].tolist():
        found = np.unique(places[bands == number])
        shared = np.searchsorted(found, end - q, "right") - np.searchsorted(found, first, "left")
        kept = np.flatnonzero(shared >= np.maximum(1, least))
        kept = kept[np.argsort(shared[kept] - (end - first)[kept], kind="stable")[::-1]]  # the likely best first
        low = number * (e + 1) - e
        for some in np.array_split(kept, -(-len(kept) // 32)) if len(kept) else ():
            begin = first[some] + low
            texts = [np.r_[np.full(max(0, -s), 2**33), b[max(0, s) : max(0, s + n + 4 * e)].astype(np.int64)] for s, n in zip(begin.tolist(), (end - first)[some].tolist())]
            changed = int(_aligned([a[s:t].astype(np.int64) for s, t in zip(first[some], end[some])], texts, e).min())
            if changed <= e and (best is None or changed < best):
                best = changed
            if best == 0:
                return 0
    return best


def leaked_items(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW, edits: int = 0) -> DataFrame:
    """``(doc, item, edits)`` for every document with each item of which it holds a passage.

    ``edits`` in the result is the least number of changed characters of the
    canonical texts with which any passage occurs. Null, empty and sign-only
    texts on either side, items shorter than the window and rows with a null id
    give no case; repeated rows one. Other columns are ignored; empty tables give
    an empty result. The budget must leave something to share: ``2 * window + 1 >
    q * (edits + 1)``, which holds by the choice of q.
    """
    bounds = Bounds(window, edits)
    session = documents.sparkSession
    kind = documents.schema[doc].dataType.simpleString()
    parts = cut(_parts_of_items(items, item, text, bounds))
    known = session.sparkContext.broadcast(_bitmap(parts, bounds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, (1,), DOCUMENTS):
                yield _table("d", batch.column(0), _regions(batch.column(1).to_pylist(), known.value, bounds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, (2, 3), PAIRS):
                found = [occurrence(p, r, bounds) for p, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                good = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), pa.array([x for x in found if x is not None], pa.int32())], names=["part", "region", "edits"])

    rows = documents.select(doc, text).filter(f"`{doc}` is not null and length(`{text}`) > 0")
    regions = cut(rows.mapInArrow(scan, f"doc {kind}, region string, body string, picked array<bigint>"))
    shapes, bodies = regions.dropDuplicates(["region"]), parts.dropDuplicates(["part"])
    seeds = shapes.select("region", F.explode("picked").alias("h")).join(bodies.select("part", F.explode("picked").alias("h")), "h")
    pairs = seeds.select("region", "part").distinct()
    texts = pairs.join(shapes.select("region", F.col("body").alias("theirs")), "region").join(bodies.select("part", "body"), "part")
    # counting and aligning is work out of proportion to the bytes, by which adaptive planning would put it into few tasks
    spread = int(session.conf.get("spark.sql.shuffle.partitions"))
    judged = texts.select("part", "region", "body", "theirs").repartition(spread).mapInArrow(judge, "part string, region string, edits int")
    cases = judged.join(regions.select("doc", "region"), "region").join(parts.select("item", "part"), "part")
    return cases.groupBy("doc", "item").agg(F.min("edits").alias("edits")).toDF(doc, item, "edits")
