"""Collapsing runs of identical or near-identical consecutive events.

A sequence is cut into runs so that the sum of each element's dissimilarity
from its run's representative, plus a penalty per boundary, is least. The
recursion keeps, for each value, the cost of the best segmentation of the
prefix whose last run is represented by that value; a value whose cost has
come to exceed the best one by the penalty can never be the better way on, so
its past is pruned. Elements that repeat are taken as one step: a boundary
within a stretch of equal elements can always be moved to its edge at no cost,
so no optimum is lost, and the work follows the number of changes.

With a penalty below half the least dissimilarity of different values, no run ever
mixes values, and the optimum is the list of maximal runs. A null element is no
event: it ends a run and belongs to none.

A sequence is one row (an array), so a task holds a few of them at a time and
nothing is shuffled but the distinct results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows decoded together; long sequences make even few rows a large batch.
ROWS_AT_ONCE = 512


def segment(codes: list[int], weights: list[int], distance: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """Optimal runs ``(first, last, value)`` over steps ``codes`` of ``weights`` elements each.

    ``distance[a, b]`` is the dissimilarity of value ``b`` from representative
    ``a``. Ties prefer going on with the run, then the smaller value code.
    """
    values = sorted(set(codes))
    rows = distance.tolist()
    cost, since = {v: penalty for v in values}, {v: 0 for v in values}
    best, before = 0.0, []  # before[i]: (start of the last run, its value) of the best segmentation of steps 0..i
    for i, (code, weight) in enumerate(zip(codes, weights)):
        limit, top, choice = best + penalty if i else penalty, None, None
        for v in values:
            c = cost[v]
            if c > limit:  # pruned: a new run from here is cheaper for good
                c, since[v] = limit, i
            c += weight * rows[v][code]
            cost[v] = c
            if top is None or c < top:
                top, choice = c, v
        best = top
        before.append((since[choice], choice))
    runs, end = [], len(codes) - 1
    while end >= 0:
        first, value = before[end]
        runs.append((first, end, value))
        end = first - 1
    return runs[::-1]


def _steps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of equal codes."""
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return starts, np.diff(np.r_[starts, len(codes)])


def _runs_of_rows(lists: pa.Array, normal: Callable[[object], str | None], names: list[str], distance: np.ndarray, penalty: float):
    """(row, value code, start, count, odd ones) of every run in a batch of arrays."""
    flat, offsets = lists.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
    words = flat.dictionary_encode()
    known = {v: i for i, v in enumerate(names)}
    of_word = np.array([known.get(normal(x), -1) for x in words.dictionary.to_pylist()] + [-1])
    codes = of_word[pc.fill_null(words.indices, len(of_word) - 1).to_numpy(zero_copy_only=False)]
    out = []
    for row in range(len(lists)):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        if lo == hi:
            continue
        starts, sizes = _steps(codes[lo:hi])
        vals, starts, sizes = codes[lo:hi][starts].tolist(), starts.tolist(), sizes.tolist()
        i = 0
        while i < len(vals):
            if vals[i] < 0:
                i += 1
                continue
            j = i
            while j < len(vals) and vals[j] >= 0:
                j += 1
            for a, b, v in segment(vals[i:j], sizes[i:j], distance, penalty):
                first, last = i + a, i + b
                odd = sum(sizes[k] for k in range(first, last + 1) if vals[k] != v) if b > a else 0
                out.append((row, v, starts[first], starts[last] + sizes[last] - starts[first], odd))
            i = j
    return out


def collapse_runs(
    rows: DataFrame,
    entity: str,
    field: str,
    values: list[str],
    normal: Callable[[object], str | None],
    penalty: float = 0.25,
    distance: list[list[float]] | None = None,
    least: int = 1,
    step_ms: int = 160,
) -> DataFrame:
    """Runs of the array column ``field``: entity, value, start, number of elements, of those other than the value, duration.

    ``normal`` maps a raw element to one of ``values`` or to None (no event);
    it is called once per distinct element of a batch. ``distance`` defaults
    to 0 for equal and 1 for different values. Only runs of ``least`` elements
    or more are returned, each row once.

    Null and empty arrays, and arrays of nulls only, have no run; a null entity
    is kept as null. Repeated rows give one result. Other columns are ignored.
    """
    costs = np.array(distance, dtype=float) if distance is not None else 1.0 - np.eye(len(values))
    names = list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = _runs_of_rows(batch.column(1), normal, names, costs, penalty)
                found = [x for x in found if x[3] >= least]
                row, value, start, count, odd = zip(*found) if found else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array([names[v] for v in value], pa.string()),
                        pa.array(start, pa.int32()),
                        pa.array(count, pa.int32()),
                        pa.array(odd, pa.int32()),
                    ],
                    names=[entity, "run_state", "start_chunk", "chunk_count", "odd_chunks"],
                )

    schema = f"{entity} string, run_state string, start_chunk int, chunk_count int, odd_chunks int"
    found = rows.select(F.col(entity).cast("string").alias(entity), F.col(field)).filter(F.size(field) > 0).mapInArrow(run, schema)
    return found.distinct().withColumn("duration_ms", F.col("chunk_count").cast("bigint") * step_ms)
