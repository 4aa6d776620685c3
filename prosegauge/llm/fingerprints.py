"""Document fingerprints: quartile bucket digests.

Byte triplets within a sliding window of four bytes (its first byte with two of the
others) are hashed into 256 buckets and counted.  The digest holds, for every bucket, in which quartile of all bucket
counts its own count lies (2 bits), and the length of the text on a log scale:
two hex digits of length and 128 of quartiles.  Digests are compared by a bounded
score: quartile steps apart (3 steps count 6) and the length's difference, scaled
to a likeness from 0 to 1.  Equal texts have equal digests and likeness 1.

``with_neighbours`` pairs every text with the next one in a total order and with
an edited copy of itself.  Texts cross the network once: rows are dealt by
ranges of the id and, where an id has many rows, of a hash of the text; bounds are
quantiles.  They are sorted there; a task reads on to the next row, and the first
row of each range is also sent to the range before.  No task holds more than two
texts and the digests of a small part of a batch.

Defined cases: null text is empty (all quartiles 0); rows that repeat an id
follow each other, ordered by a hash of the text, and are dealt to several ranges
where they are many (equal rows stay together); null ids come last; the last
row's next is the first, so a single row is its own next; very long texts are
counted in pieces; an empty table gives an empty table; further columns are left
out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from prosegauge.llm.batches import parts

BUCKETS = 256
PIECE = 1 << 20
LENGTH_STEPS = 6
NULL_ID = -(1 << 63)


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of ``data``."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for k in range(0, max(0, len(data) - 2), PIECE):
        b = np.frombuffer(data, dtype=np.uint8, count=min(PIECE + 3, len(data) - k), offset=k).astype(np.uint32)
        # the window at the end of the text has three bytes only
        three = min(PIECE, len(b) - 2)
        first, second, third = b[:three], b[1 : three + 1] << np.uint32(8), b[2 : three + 2] << np.uint32(16)
        four = min(three, len(b) - 3)
        fourth = b[3 : four + 3] << np.uint32(16)
        for salt, triplet in ((1, first | second | third), (2, first[:four] | second[:four] | fourth), (3, first[:four] | (third[:four] >> np.uint32(8)) | fourth)):
            hashed = (triplet + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            counts += np.bincount((hashed * np.uint32(0x85EBCA77)) >> np.uint32(24), minlength=BUCKETS)
    return counts


def length_step(n: int) -> int:
    return min(255, int(math.log2(n + 1) * 8))


def fingerprint(data: bytes) -> str:
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quartile.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)
    return f"{length_step(len(data)):02x}" + packed.sum(axis=1, dtype=np.uint8).tobytes().hex()


_APART = np.array([[(0, 1, 2, 6)[abs(a - b)] for b in range(4)] for a in range(4)])
_SPREAD = np.array([6, 4, 2, 0], dtype=np.uint8)


def difference(a: str, b: str) -> int:
    """Quartile steps apart, and at most 48 for the length."""
    x, y = (np.frombuffer(bytes.fromhex(d), dtype=np.uint8) for d in (a, b))
    qx, qy = (((d[1:, None] >> _SPREAD) & 3).ravel() for d in (x, y))
    return int(_APART[qx, qy].sum()) + min(48, LENGTH_STEPS * abs(int(x[0]) - int(y[0])) // 4)


def likeness(a: str, b: str) -> float:
    """1 for equal digests; 0 from a difference of 1.5 a bucket, which is more
    than that of unrelated texts (quartiles drawn at random differ by 1.5)."""
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / (1.5 * BUCKETS + 1))


def fingerprint_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every text, without any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [fingerprint(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _bounds(keyed: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Sorted ``key`` and ``tie`` at which ranges begin: quantiles of the key and, of a
    key that would fill several ranges, of its ties."""
    at = [k / ranges for k in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("key", at, 100 * ranges).alias("b")).first()["b"] if at else None
    times = Counter(found or [])
    hot = [key for key, n in times.items() if n > 1]
    out = [(key, NULL_ID) for key in times]
    if hot:
        slices = [k / ranges for k in range(1, ranges)]
        ties = keyed.where(F.col("key").isin(hot)).groupBy("key").agg(F.percentile_approx("tie", slices, 100 * ranges).alias("b"))
        for r in ties.collect():
            n = times[r["key"]]
            out += [(r["key"], r["b"][len(slices) * k // n]) for k in range(1, n)]
    return sorted(set(out))


def with_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next`` of each text, in
    descending order of an integer id."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # ~key ascends as the id descends
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.bitwise_not(key).alias("key"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")
    )
    bounds = _bounds(keyed.select("key", "tie"), ranges)
    keys = np.array([k for k, _ in bounds], dtype=np.int64)

    def range_of(key: pa.Array, tie: pa.Array) -> pa.Array:
        """How many bounds are not after a row."""
        key, tie = key.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for k in np.flatnonzero(low < high).tolist():  # rows of an id at which a range begins
            low[k] = bisect_right(bounds, (key[k], tie[k]), low[k], high[k])
        return pa.array(low, pa.int32())

    keyed = keyed.withColumn("part", F.arrow_udf(range_of, IntegerType())("key", "tie"))
    heads = keyed.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("part").collect()
    # the range before, of those that have rows; the last range is before the first
    before = [(r["head"]["key"], r["head"]["tie"], heads[k - 1]["part"]) for k, r in enumerate(heads)]
    columns = zip(*before) if before else ([], [], [])
    kinds = (pa.int64(), pa.int64(), pa.int32())
    to = spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "tie", "to"), columns, kinds)}))
    ahead = (
        keyed.join(F.broadcast(to), ["key", "tie"])
        .groupBy("to")
        .agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("tie").alias("tie"), F.first("text").alias("text"))
        .select("doc_id", "key", "tie", "text", F.col("to").alias("part"), F.lit(1).alias("ahead"))
    )
    dealt = keyed.withColumn("ahead", F.lit(0)).unionByName(ahead)
    ordered = dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "ahead", "key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is still to come
        for batch in parts(batches):
            out: list[tuple] = []
            for doc, text, part, ahead in zip(*(batch.column(k).to_pylist() for k in range(4))):
                text = text or ""
                digest = fingerprint(text.encode())
                if held and held[2] == part and not held[4]:
                    own, own_text, _, own_digest, _ = held
                    changed = edited(own_text, text).encode()
                    changed_digest = fingerprint(changed)
                    out.append(
                        (own, len(own_text), hashlib.sha256(changed).hexdigest(), own_digest, changed_digest)
                        + (likeness(own_digest, changed_digest), likeness(own_digest, digest))
                    )
                held = (doc, text, part, digest, ahead)
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, x)) for x in out], schema=_OUT)

    _OUT = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )
    return ordered.select("doc_id", "text", "part", "ahead").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
