"""Line dedup with a once-seen and a twice-seen Bloom filter.

1. Hashes of line keys (one per document and key, combined in every task) are dealt by
   value; each task has a once-seen Bloom filter of its own, and hashes that it
   holds already make the twice-seen filter, which is broadcast (see ``sketch``).
2. Only keys that the second filter holds leave their task.  They are grouped
   exactly by a 128-bit digest: number of documents, and first occurrence.  With
   more suspects than a filter may have, keys are joined with them instead.
3. Keys found in at least ``min_docs`` documents are dropped from the texts.
   Their digests are broadcast while there are at most ``broadcast_keys`` of
   them; beyond that each document receives its own digests by a join.

A line's key is the line stripped of ``[ \\t\\n\\v\\f\\r]`` at both ends with A-Z
lower-cased.  Keys under ``min_chars`` code points are never dropped.

Defined cases: a null text counts as empty (one empty line); rows that repeat
a ``doc_id`` count as one document; a very long text is handled line by line
in its own task; an empty table gives an empty table; further columns of the
input are carried through unless they bear a name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from prosegauge.llm import sketch
from prosegauge.llm.batches import parts
from prosegauge.llm.joins import join_counted
from prosegauge.runtime import cut

STRIPPED = b" \t\n\x0b\x0c\r"
RESULT = ("n_lines", "n_dropped", "kept_text")


def line_key(line: bytes) -> bytes:
    """bytes.lower() changes A-Z only, and UTF-8 never reuses those bytes."""
    return line.strip(STRIPPED).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key, 42)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, most: int = sketch.MOST) -> DataFrame:
    """digest, first_id, first_line and number ``n`` of each key found in ``min_docs`` documents."""
    lines = docs.agg(F.sum(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1).alias("n")).first()["n"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def keys(text: bytes) -> dict[bytes, int]:
        """Digest of each key of the text, with its first line's number."""
        found: dict[bytes, int] = {}
        for k, line in enumerate(text.split(b"\n")):
            key = line_key(line)
            if key and code_points(key) >= min_chars:
                found.setdefault(digest(key), k)
        return found

    def hashes(found: dict[bytes, int]) -> np.ndarray:
        return np.frombuffer(b"".join(found), dtype=np.uint64)[::2]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sketch.Gathered()
        for batch in parts(batches):
            for text in _texts(batch.column(0)):
                if found := keys(text):
                    yield from held.add(hashes(found))
        yield from held.flush()

    suspects = sketch.suspects(texts.select("text").mapInArrow(gathered, sketch.HASHES), int(lines or 0), rows=2)
    twice = sketch.Filter.of(suspects, most)
    shared = docs.sparkSession.sparkContext.broadcast((twice.bits, twice.cells) if twice else None)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value and sketch.Filter(*shared.value)
        for batch in parts(batches):
            ids, digests, firsts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if found := keys(text):
                    for held, (d, k) in zip(twice.holds(hashes(found)) if twice else repeat(True), found.items()):
                        if held:
                            ids.append(doc)
                            digests.append(d)
                            firsts.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(ids, batch.schema.field(0).type), pa.array(firsts, pa.int32()),
                 pa.array(np.frombuffer(b"".join(digests), dtype=np.int64)[::2])],
                names=["digest", "doc_id", "line", "hash"],
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    seen = texts.mapInArrow(occurrences, f"digest binary, doc_id {id_type}, line int, hash long")
    if twice is None:
        seen = join_counted(seen, suspects, ["hash"], total=int(lines))
    per_doc = seen.groupBy("digest", "doc_id").agg(F.min("line").alias("line"))
    return (
        per_doc.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
        .where(F.col("n") >= min_docs)
        .select("digest", "n", F.col("first.doc_id").alias("first_id"), F.col("first.line").alias("first_line"))
    )


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    broadcast_keys: int = 500_000,
    most_suspects: int = sketch.MOST,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    ``keep_first`` leaves the first occurrence (smallest id, then line) of a
    dropped key in place.  ``broadcast_keys`` and ``most_suspects`` bound what is
    broadcast: 16 bytes of digest and the first occurrence for each key, a byte of
    filter for each suspect.
    """
    kept_cols = [c for c in docs.columns if c not in RESULT]
    repeated = cut(repeated_keys(docs, id_col, text_col, min_docs, min_chars, most_suspects))
    id_at, text_at = kept_cols.index(id_col), kept_cols.index(text_col)
    n = repeated.count()
    spark = docs.sparkSession

    def kept(doc: object, text: bytes, dropped: dict[bytes, tuple]) -> tuple[int, int, bytes]:
        lines = text.split(b"\n")
        out = []
        for k, line in enumerate(lines):
            key = line_key(line)
            first = dropped.get(digest(key)) if key and code_points(key) >= min_chars else None
            if first is None or (keep_first and first == (doc, k)):
                out.append(line)
        return len(lines), len(lines) - len(out), b"\n".join(out)

    def apply(batch: pa.RecordBatch, lookup) -> pa.RecordBatch:
        found = [
            kept(doc, text, lookup(k))
            for k, (doc, text) in enumerate(zip(batch.column(id_at).to_pylist(), _texts(batch.column(text_at))))
        ]
        new = [
            pa.array([x[0] for x in found], pa.int64()),
            pa.array([x[1] for x in found], pa.int64()),
            pa.array([x[2] for x in found], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept_cols)], *new], names=[*kept_cols, *RESULT])

    source = docs.select(*kept_cols)
    out_schema = StructType(list(source.schema.fields))
    for name, kind in zip(RESULT, (LongType(), LongType(), StringType())):
        out_schema = out_schema.add(name, kind)
    if n <= broadcast_keys:
        table = {bytes(r["digest"]): (r["first_id"], r["first_line"]) for r in repeated.collect()}
        shared = spark.sparkContext.broadcast(table)

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                yield apply(batch, lambda k: shared.value)

        return source.mapInArrow(by_broadcast, out_schema)

    # a row is known by hashes of its id and text: rows that repeat an id, or have none, stay apart
    row = lambda: F.xxhash64(id_col, text_col)

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, digests = [], []
            for of, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                own = {digest(key) for line in text.split(b"\n") if (key := line_key(line)) and code_points(key) >= min_chars}
                rows += [of] * len(own)
                digests += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary())], names=["row", "digest"])

    own = source.select(row().alias("row"), text_col).mapInArrow(own_keys, "row long, digest binary").distinct()
    hits = join_counted(own, repeated.withColumnRenamed("n", "count"), ["digest"], total=source.count())
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("digest", "first_id", "first_line")).alias("hits"))
    joined = source.withColumn("_row", row()).join(hits, F.col("_row") == F.col("row"), "left").select(*[source[c] for c in kept_cols], "hits")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            hit = batch.column(len(kept_cols)).to_pylist()
            yield apply(batch, lambda k: {h["digest"]: (h["first_id"], h["first_line"]) for h in hit[k] or ()})

    return joined.mapInArrow(by_join, out_schema)
