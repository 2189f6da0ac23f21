"""Arrow batches cut to bounded sizes, for the operators that need Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of the named text or binary column; one very long value makes a batch of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def pieces(batches: Iterable[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches of nested columns into slices of about `limit` bytes, counted by the mean row."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(limit * batch.num_rows / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)
