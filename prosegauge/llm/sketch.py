"""Which hashes may occur more than once, found with sketches of bounded size.

``suspects`` deals hashes by value to as many tasks as their number needs, so that the
share of hashes that look repeated does not grow with the data.  Every task has a
sketch of its own hashes: ``rows`` independent cells a hash.  A hash all of whose
cells are taken when it comes may have come before.  With counters that stop at
two this is a count-min sketch, read as bits the once-seen Bloom filter; it
never misses a repeated hash.

``Filter`` is the twice-seen Bloom filter of what was suspected, sized by its number and
small enough to be broadcast; with more than ``MOST`` suspects there is none, and
callers join the suspects instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.runtime import cut

#: Hashes a task of ``suspects`` may have, and cells for each at least.
A_TASK, CELLS_A_HASH = 1 << 22, 8
#: Suspects that a filter may have (a byte each in it).
MOST = 1 << 25
HELD = 1 << 19
FILTER_ROWS, SEGMENT_BITS = 4, 6
HASHES = "hash long, times long"


def cell_numbers(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Cell of each uint64 hash in one row; ``cells`` is a power of two."""
    odd = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[row])
    mixed = (hashes ^ (hashes >> np.uint64(29))) * odd
    return mixed >> np.uint64(64 - (cells.bit_length() - 1))


def _segment(hashes: np.ndarray) -> np.ndarray:
    """Low bits: hashes that were chosen for being small differ little in the high ones."""
    return (hashes & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def _power(n: float) -> int:
    return 1 << max(10, (max(1, int(n)) - 1).bit_length())


class Once:
    """Cells that have been hit by the hashes of one task."""

    def __init__(self, cells: int, rows: int):
        self.cells = cells
        self.bits = np.zeros((rows, cells // 8), dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Which of distinct hashes may have been added before."""
        before = np.ones(len(hashes), dtype=bool)
        for row, bits in enumerate(self.bits):
            at = cell_numbers(hashes, row, self.cells)
            byte, bit = at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
            before &= (bits[byte] & bit) != 0
            np.bitwise_or.at(bits, byte, bit)
        return before


class Gathered:
    """Distinct hashes of a task's rows, a bounded run at a time, with their times."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            hashes, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times)], names=["hash", "times"])


def suspects(hashes: DataFrame, expected: int, rows: int, cells: int | None = None) -> DataFrame:
    """``hash`` and ``count`` of every hash that may occur twice.

    ``hashes`` are batches of ``Gathered``; ``expected`` is about their number.  Counts
    leave out each hash's first batch, so they tell hot hashes from others.
    """
    tasks = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // A_TASK))
    size = cells or _power(CELLS_A_HASH * expected / tasks)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once(size, rows)
        for batch in batches:
            found, at = np.unique(batch.column(0).to_numpy().view(np.uint64), return_inverse=True)
            times = np.bincount(at, weights=batch.column(1).to_numpy()).astype(np.int64)
            held = once.add(found) | (times > 1)
            yield pa.RecordBatch.from_arrays([pa.array(found[held].view(np.int64)), pa.array(times[held])], names=["hash", "times"])

    seen = hashes.repartition(tasks, "hash").mapInArrow(fold, HASHES)
    return cut(seen.groupBy("hash").agg(F.sum("times").alias("count")))


class Filter:
    """Bloom filter of the hashes of a table, of a byte a hash and more."""

    def __init__(self, bits: np.ndarray, cells: int):
        self.bits, self.cells = bits, cells

    @classmethod
    def of(cls, found: DataFrame, most: int = MOST) -> Filter | None:
        """The filter of ``hash``, or None if there are more than ``most``.

        It is built in segments on the executors; the driver receives its bytes only.
        """
        n = found.count()
        if n > most:
            return None
        segments = 1 << SEGMENT_BITS
        cells = _power(8 * n / segments)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column(0).to_numpy().view(np.uint64)
                of = _segment(x)
                for k in np.unique(of).tolist():
                    part = made.setdefault(k, np.zeros(cells // 8, dtype=np.uint8))
                    for row in range(FILTER_ROWS):
                        at = cell_numbers(x[of == k], row, cells)
                        np.bitwise_or.at(part, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            for k, part in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "bits"])

        segment = F.col("hash").bitwiseAND(F.lit(segments - 1))
        bits = np.zeros((segments, cells // 8), dtype=np.uint8)
        if n:
            tasks = min(segments, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            for r in found.select("hash").repartition(tasks, segment).mapInArrow(build, "segment int, bits binary").collect():
                bits[r["segment"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        return cls(bits, cells)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each uint64 hash whether it may be one (never False for one that is)."""
        out = np.ones(len(hashes), dtype=bool)
        of = _segment(hashes)
        for row in range(FILTER_ROWS):
            at = cell_numbers(hashes, row, self.cells)
            out &= (self.bits[of, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out
