"""Bounded pieces of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounded(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds at most `most` bytes of the text column (or items of the list column), or one row.

    Long texts thus never add up in a worker's memory, however many rows Spark puts into a batch.
    """
    for batch in batches:
        values = batch.column(column)
        sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch if start == 0 and stop == batch.num_rows else batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])
