"""Removal of word windows that occur more than once, after a count-min prefilter.

A window is ``window`` (35) consecutive words of a text.  Each word covered by a
window whose words also start anywhere else is removed.

1. Every window is represented in the sketch by its anchor: the least hash of its
   16-word grams.  Equal windows have equal anchors at equal offsets, so an
   anchor occurs at least as often as any of its windows and its count is an
   overestimate of theirs, while there are some ten times fewer of them.  Anchors,
   combined in every task, are dealt by value to tasks that each count their own
   share in a count-min sketch (see ``sketch``), whatever the size of the input.
2. Windows whose estimate is 2 or more are grouped exactly by 96 bits of hash.
   Of the groups only those travel back that turn out single: the sketch's false
   alarms.
3. Every text is read once more: windows with estimate 2 less its false alarms
   are the repeated ones.

Repeated anchors are broadcast as a filter while it may be, else each text receives
its own by a join; false alarms are broadcast while there are at most
``broadcast_alarms``, else joined to their texts.

Defined cases: a null text has no words; texts under 35 words have no window and
stay; a text that repeats itself repeats its windows; rows that repeat a
``doc_id`` are separate texts (so equal rows repeat each other); very long texts
take memory in proportion to that one text; an empty table gives an empty table;
further columns are carried through unless they bear a name of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

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

GRAM = 16
ROWS = 3
RESULT = ("n_words", "n_removed", "kept_text")
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
HELD_WORDS = 1 << 18


class WordHashes(dict):
    """64-bit hash of each word met; emptied when it has grown large."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of all runs of k words, for any k."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(hashes):
            size = max(1024, 2 * len(hashes))
            steps = np.full(size, self.base, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.powers, self.inverses = (np.cumprod(s) for s in steps)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: len(hashes)])])

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        x = (prefix[k:] - prefix[:-k]) * self.inverses[: len(prefix) - k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over ``width`` neighbours, in log steps."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


class Windows:
    """Hashes of the windows of one text after another."""

    def __init__(self, window: int):
        self.window, self.gram = window, min(GRAM, window)
        self.span = window - self.gram + 1
        self.first = WordHashes(1)
        self.roll_a, self.roll_b = Rolling(BASE_A), Rolling(BASE_B)

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The words' hashes, prefix sums, the grams' hashes and each window's anchor."""
        if len(words) < self.window:
            return None
        hashes = self.first.of(words)
        prefix = self.roll_a.prefix(hashes)
        grams = self.roll_a.runs(prefix, self.gram)
        return hashes, prefix, grams, sliding(grams, self.span, np.minimum)

    def chosen(self, grams: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Hashes of the grams that are the anchor of some window, a value for each place."""
        edge = np.zeros(self.span - 1, dtype=np.uint64)
        return grams[sliding(np.concatenate([edge, anchors, edge]), self.span, np.maximum) == grams]

    def hashes(self, hashes: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window: a second base over otherwise mixed words."""
        mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        second = self.roll_b.runs(self.roll_b.prefix(mixed ^ (mixed >> np.uint64(27))), self.window)
        return self.roll_a.runs(prefix, self.window).view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def estimated(holds: Callable[[np.ndarray], np.ndarray], anchors: np.ndarray) -> np.ndarray:
    """Whether each window is estimated repeated; neighbours mostly share an anchor."""
    new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    return holds(anchors[new])[np.cumsum(new) - 1]


def held_in(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x a sorted array holds."""
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for text in column.cast(pa.binary()):
        yield (text.as_py() or b"").split()


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    broadcast_alarms: int = 500_000,
    most_suspects: int = sketch.MOST,
    cells: int | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words
    joined by one space).  ``cells`` forces the size of each task's sketch."""
    spark = docs.sparkSession
    kept_cols = [c for c in docs.columns if c not in RESULT]
    source = docs.select(*kept_cols)
    text_at = kept_cols.index(text_col)
    # a row is known by a hash of its id and text: rows that repeat an id, or have none, stay apart
    texts = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    expected = int(chars / 6 * 2 / (max(1, window - GRAM + 1) + 1))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = Windows(window), sketch.Gathered()
        for batch in parts(batches):
            for words in _texts(batch.column(0)):
                if found := made.anchors(words):
                    yield from held.add(made.chosen(*found[2:]))
        yield from held.flush()

    suspects = sketch.suspects(texts.select("text").mapInArrow(gathered, sketch.HASHES), expected, ROWS, cells)
    twice = sketch.Filter.of(suspects, most_suspects)
    shared = spark.sparkContext.broadcast((twice.bits, twice.cells) if twice else None)
    lists: list[tuple[str, DataFrame]] = []  # what texts receive by joins: a name, and lists by row
    if twice is None:
        lists.append(("_anchors", _own_suspects(texts, suspects, window, expected)))

    def judge() -> Callable[[np.ndarray, pa.Scalar | None], np.ndarray]:
        """Says which anchors may be repeated, by the filter or a text's own list."""
        if shared.value is None:
            return lambda anchors, own: held_in(own, anchors)
        holds = sketch.Filter(*shared.value).holds
        return lambda anchors, own: holds(anchors)

    def own_list(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray | None:
        at = batch.schema.get_field_index(name)
        return None if at < 0 else np.sort(np.array(batch.column(at)[k].as_py() or [], dtype=np.int64).view(np.uint64))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, holds = Windows(window), judge()
        for batch in parts(batches):
            out: list[list[np.ndarray]] = [[], [], []]
            for k, (row, words) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(1)))):
                if found := made.anchors(words):
                    own = own_list(batch, "_anchors", k)
                    held = estimated(lambda x: holds(x, own), found[3])
                    if held.any():
                        a, b = made.hashes(*found[:2])
                        for to, x in zip(out, (a[held], b[held], np.full(int(held.sum()), row, dtype=np.int64))):
                            to.append(x)
            if out[0]:
                whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b", "row"])
                for k in range(0, whole.num_rows, 1 << 17):
                    yield whole.slice(k, 1 << 17)

    singles = (
        _with_lists(texts, "row", lists)
        .mapInArrow(occurrences, "a long, b int, row long")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.first("row").alias("row"))
        .where("n = 1")
        .select("row", "a")
    )
    alarms = cut(singles)
    bounded = alarms.count() <= broadcast_alarms
    if bounded:
        known = spark.sparkContext.broadcast(np.sort(alarms.select("a").toArrow().column(0).to_numpy().view(np.uint64)))
    else:
        known = None
        lists.append(("_alarms", alarms.groupBy("row").agg(F.collect_list("a").alias("list"))))

    def kept(made: Windows, words: list[bytes], holds, alarms: np.ndarray) -> tuple[int, int, bytes]:
        n, found = len(words), made.anchors(words)
        if found:
            repeated = estimated(holds, found[3])
            if repeated.any():
                starts = np.flatnonzero(repeated)
                starts = starts[~held_in(alarms, made.roll_a.runs(found[1], window)[starts])]
                edges = np.zeros(n + 1, dtype=np.int64)
                edges[starts] += 1
                edges[starts + window] -= 1
                keep = np.cumsum(edges[:-1]) == 0
                left = list(compress(words, keep.tolist()))
                return n, n - len(left), b" ".join(left)
        return n, 0, b" ".join(words)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, holds = Windows(window), judge()
        for batch in parts(batches):
            found = []
            for k, words in enumerate(_texts(batch.column(text_at))):
                own = own_list(batch, "_anchors", k)
                alarms = own_list(batch, "_alarms", k) if known is None else known.value
                found.append(kept(made, words, lambda x: holds(x, own), alarms))
            new = [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept_cols)], *new], names=[*kept_cols, *RESULT])

    out_schema = StructType(list(source.schema.fields))
    for name, kind in zip(RESULT, (LongType(), LongType(), StringType())):
        out_schema = out_schema.add(name, kind)
    if not lists:
        return source.mapInArrow(finish, out_schema)
    # names that cannot clash with those of the input, which are put back by place
    numbered = source.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept_cols)], F.xxhash64(id_col, text_col).alias("row"))
    return _with_lists(numbered, "row", lists).drop("row").mapInArrow(finish, out_schema)


def _own_suspects(texts: DataFrame, suspects: DataFrame, window: int, expected: int) -> DataFrame:
    """Lists of each row's anchors that are suspected."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(window)
        for batch in parts(batches):
            for row, words in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                if found := made.anchors(words):
                    x = np.unique(made.chosen(*found[2:])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), row, dtype=np.int64))], names=["hash", "row"])

    rows = texts.mapInArrow(own, "hash long, row long")
    return cut(join_counted(rows, suspects, ["hash"], total=expected).groupBy("row").agg(F.collect_set("hash").alias("list")))


def _with_lists(rows: DataFrame, key: str, lists: list[tuple[str, DataFrame]]) -> DataFrame:
    for name, found in lists:
        rows = rows.join(found.select(F.col("row").alias("_of"), F.col("list").alias(name)), rows[key] == F.col("_of"), "left").drop("_of")
    return rows
