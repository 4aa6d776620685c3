"""SimHash near-duplicates found by multi-index hashing.

Fingerprint: bit i is set if it is set in over half of the 64-bit hashes of a
text's word shingles, repeats included.  Two fingerprints link if they differ in
at most ``radius`` bits.

Multi-index hashing: a fingerprint is cut into ``segments`` equal segments.  If
two fingerprints differ in at most ``2 * segments - 1`` bits, they differ in at
most one bit of some segment.  So every fingerprint is filed under each of its
segments (the tables) and looks itself up under every value one bit away (the
Hamming balls; only 0-to-1 flips, as the other side makes the others), and
whole distances are verified within a bucket.  With two segments the keys have
32 bits and stay selective for billions of fingerprints.

Work is on distinct fingerprints, so exact copies cost nothing.  A bucket gives
no pairs but a spanning forest of its links, at most one edge a member.  Filed
fingerprints of a bucket beyond ``block`` are dealt to several tasks, against
each of which all members of the bucket are verified in chunks, so a task holds
``block`` fingerprints however large the bucket is, and no link is lost.

Links by similarity of whole sets of shingles, as the corpus pipeline needs them, are
in ``similar``.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and
links like any other; a text of fewer words than the shingle has one shingle of
all its words; rows that repeat a ``doc_id`` are one document in links; a null
id is never the representative; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.batches import parts
from prosegauge.llm.components import components
from prosegauge.llm.joins import join_counted
from prosegauge.runtime import cut

CHUNK = 1 << 16
CELLS = 1 << 19


def fingerprint(text: bytes, width: int) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; bytes.lower() changes A-Z
    only and bytes.split() splits at ``[\\x20\\x09-\\x0D]``."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    shingles = max(1, len(words) - width + 1)
    last = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], last[: shingles - 1] + 1]).tolist()
    ends = last[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for k in range(0, shingles, CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1024):
            found = np.fromiter(
                (fingerprint(t.as_py() or b"", width) for t in batch.column(1).cast(pa.binary())),
                dtype=np.uint64,
                count=batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def fingerprint_hex(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def linked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of a bucket's links.  near[i, j]: filed i and member j link.

    Returns the filed one's root for each filed one, and for each member with
    links its number and its root.
    """
    rows, cols = np.nonzero(near)
    root = np.arange(near.shape[0])
    member = np.full(near.shape[1], near.shape[0])
    while True:
        before = root.copy()
        np.minimum.at(member, cols, root[rows])
        np.minimum.at(root, rows, member[cols])
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    has = np.flatnonzero(member < near.shape[0])
    return root, has, member[has]


def nearest(apart: np.ndarray, near: np.ndarray, filed: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each one of a bucket its nearest with a smaller id: ids, nearest
    ids, distances."""
    out = []
    for down in (True, False):
        allowed = near & ((filed[:, None] < member[None, :]) if down else (filed[:, None] > member[None, :]))
        gap = np.where(allowed, apart, 255)
        at = gap.argmin(axis=0 if down else 1)
        own, other = (member, filed) if down else (filed, member)
        least = gap.min(axis=0 if down else 1)
        has = least < 255
        out.append((own[has], other[at[has]], least[has]))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(
    nodes: DataFrame,
    *,
    radius: int = 3,
    segments: int = 2,
    block: int = 4096,
    words: int = 1,
    forest: bool = True,
) -> DataFrame:
    """Edges ``a``, ``b`` between ``rep`` of distinct fingerprints within ``radius``.

    Fingerprints have ``words`` columns ``fp0``, ``fp1``... of 64 bits.  For every
    bucket a spanning forest of its links (which is exact for a radius under
    ``2 * segments``), or else each one's nearest with a smaller id, and ``apart``.
    """
    size = 64 * words // segments
    if 64 % size or (forest and radius > 2 * segments - 1):
        raise ValueError("segments must divide words, and radius be under 2 * segments")
    mask, prints = (1 << size) - 1, [f"fp{k}" for k in range(words)]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts([batch], 4096):
                values = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                for s in range(segments):
                    of, shift = divmod(s * size, 64)
                    key = (values[of].view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)
                    flipped = [key] + [key | np.uint64(1 << i) for i in range(size)]
                    take = np.concatenate([[True] * len(key)] + [f != key for f in flipped[1:]])
                    role = np.repeat([0] + [1] * size, len(key))[take].astype(np.int8)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((np.concatenate(flipped)[take] * np.uint64(segments) + np.uint64(s)).view(np.int64)),
                            pa.array(role),
                            *(pa.array(np.tile(v, size + 1)[take]) for v in values),
                        ],
                        names=["bucket", "role", *prints, "rep"],
                    )

    keys = [
        F.shiftrightunsigned(f"fp{s * size // 64}", s * size % 64).bitwiseAND(F.lit(mask)) * segments + s for s in range(segments)
    ]
    filed = nodes.select(F.explode(F.array(*keys)).alias("bucket"))
    large = cut(
        filed.groupBy("bucket").count().where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    )
    of_print = ", ".join(f"{p} long" for p in prints)
    rows = nodes.select(*prints, "rep").mapInArrow(expand, f"bucket long, role byte, {of_print}, rep long")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        total = filed.count()
        rows = join_counted(rows, large, ["bucket"], total=total, how="left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = rows.where("role = 0").withColumn("part", F.pmod(F.xxhash64(*prints), F.col("blocks")).cast("int"))
        met = rows.where("role = 1 or blocks > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = own.unionByName(met.withColumn("role", F.lit(1).cast("byte"))).drop("blocks")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_rep = None, [np.empty(0, np.uint64)] * words, np.empty(0, np.int64)
        for batch in batches:
            bucket, part, role, rep, *fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = [x.view(np.uint64) for x in fp]
            if not len(rep):
                continue
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rep)]])
            found: list[tuple] = []
            # a bucket of one, or without a filed fingerprint, links nothing; the first and the last may go on
            worth = (ends - begins > 1) & (role[begins] == 0)
            worth[0] |= last == (bucket[0], part[0])
            worth[-1] = True
            for i, j in zip(begins[worth].tolist(), ends[worth].tolist()):
                now = (bucket[i], part[i])
                if now != last:
                    last, held, held_rep = now, [np.empty(0, np.uint64)] * words, np.empty(0, np.int64)
                k = i + int(np.searchsorted(role[i:j], 1))
                if k > i:
                    held = [np.concatenate([h, x[i:k]]) for h, x in zip(held, fp)]
                    held_rep = np.concatenate([held_rep, rep[i:k]])
                if not len(held_rep):
                    continue
                step = max(1, CELLS // len(held_rep))
                for p in range(i, j, step):
                    q = min(j, p + step)
                    apart = sum(np.bitwise_count(h[:, None] ^ x[None, p:q]) for h, x in zip(held, fp))
                    near = (apart <= radius) & (held_rep[:, None] != rep[None, p:q])
                    if not near.any():
                        continue
                    if forest:
                        root, has, to = linked(near)
                        found.append((rep[p:q][has], held_rep[to], None))
                        found.append((held_rep, held_rep[root], None))
                    else:
                        found.append(nearest(apart, near, held_rep, rep[p:q]))
            if found:
                a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                more = [] if forest else [np.concatenate([x[2] for x in found]).astype(np.int32)]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, *more)], names=["a", "b", *(["apart"] if more else [])])

    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "role")
    return dealt.select("bucket", "part", "role", "rep", *prints).mapInArrow(
        fold, "a long, b long" + ("" if forest else ", apart int")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 3,
    segments: int = 2,
    block: int = 4096,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest doc_id that links reach) of every row."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("count")))
    edges = links(nodes.where("rep is not null").select(F.col("fp").alias("fp0"), "rep"), radius=radius, segments=segments, block=block)
    found = components(edges)
    named = cut(nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "count"))
    every = join_counted(prints, named, ["fp"], total=prints.count())
    return every.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
