"""Working through Arrow batches in parts of bounded size, as texts may be of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on together; a longer text is a part of its own.
PART = 4_000_000


def parts(batch: pa.RecordBatch, columns: tuple[int, ...], rows: int, size: int = PART) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``size`` bytes in the text columns; null texts have none."""
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop
