"""Arrow batches cut by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the n + 1 offsets into them; no copy. Nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds at most ``max_bytes`` of ``column`` (a longer row comes alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = flat(batch.column(column))
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
            last = min(max(last, first + 1), n)
            yield batch.slice(first, last - first)
            first = last
