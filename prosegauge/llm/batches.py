"""Arrow batches in small parts, so that neither side holds many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

ROWS = 256


def parts(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def packed(arrays: Iterable[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as binary values."""
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in column]
