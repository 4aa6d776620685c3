"""Near-duplicate texts: SimHash links, completed by an exact set join.

Texts link at a Jaccard similarity of ``similarity`` or more of their sets of
``width``-word shingles, and all such links are found:

1. *Who can have a partner.*  Shingles are ordered by their hash.  Two similar sets
   share the first of their common shingles near the beginning of both: of the first
   ``n - ceil(similarity * n) + spare`` of a set at least ``similarity * spare`` stand
   in the partner's beginning too.  So only these beginnings are dealt by hash, and
   a set too few of whose first shingles turn up in another set has no partner.
   Shingles in more than one in a thousand texts are known beforehand (a bounded
   list) and count as shared without being dealt.
2. *SimHash.*  What is left gets 128-bit fingerprints, multi-index hashing in eight
   segments, and each set offers from every bucket its nearest candidate within 30
   bits.  Each one's nearest is verified by the whole sets, then, of what is still
   in different components, the nearest between two.  This joins most of each group
   without listing its pairs.
3. *Exact join* of what is still in different components: the frequent shingles
   last, two similar sets share one of the first ``n - ceil(similarity * n) + 1`` of
   each.  Sets meet by these; pairs whose sizes or places leave no room for the
   overlap are left out, then those whose bitmaps (four bits a shingle) show that they
   have too few in common.  Of each two components the most promising pair is
   verified by its sets first, and then, of what is still in different components,
   all others, block against block.

Equal sets are one node throughout, so exact copies cost nothing.  Shingles and
nodes are known by 64-bit hashes.

Defined cases: texts without words link to each other; a text of fewer words
than the shingle has one shingle of all its words; rows that repeat an id are one
document, whatever their texts, and link what their texts link; rows without an
id are left out; an empty table gives an empty table; further columns do not
matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import sketch
from prosegauge.llm.batches import packed, parts, unpacked
from prosegauge.llm.components import components
from prosegauge.llm.joins import join_counted, only
from prosegauge.llm.simhash import links
from prosegauge.runtime import cut

SPARE = 0.05
COMMON = 1000  # a shingle in more than one in so many texts is dealt with apart
A_RUN = 1 << 19  # hashes that a task counts at once
ROUNDS = 1  # of candidates that SimHash offers beyond the nearest
CELLS = 1 << 18  # pairs that a task compares at once


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; bytes.lower() changes
    A-Z only and bytes.split() splits at ``[\\x20\\x09-\\x0D]``."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    last = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = np.concatenate([[0], last[: n - 1] + 1]).tolist(), last[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends)), dtype=np.uint64, count=n).view(np.int64))


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), dtype=np.uint64, count=len(sets)).view(np.int64)


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of shingles, as two signed numbers."""
    counts = np.zeros(128, dtype=np.int64)
    for k in range(0, len(shingles), 1 << 16):
        x = shingles[k : k + (1 << 16)].view(np.uint64)
        both = []
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            y = (x ^ (x >> np.uint64(32))) * np.uint64(odd)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            both.append((y ^ (y >> np.uint64(32))).astype(">u8").view(np.uint8).reshape(-1, 8))
        counts += np.unpackbits(np.hstack(both), axis=1).sum(axis=0, dtype=np.uint32)
    return tuple(np.packbits(2 * counts > len(shingles)).view(">i8").tolist())


def least_overlap(n, similarity: float):
    """How many of n shingles a similar set has at least."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def beginnings(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id``, ``node`` (a hash of the whole set), ``n`` and ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = [shingle_set(t.as_py() or b"", width) for t in part.column(1).cast(pa.binary())]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            take = np.minimum(n, n - least_overlap(n, similarity) + np.maximum(1, np.ceil(SPARE * n - 1e-6).astype(np.int64)))
            first = packed(x[:k] for x, k in zip(sets, take.tolist()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node_of(sets)), pa.array(n), first], names=["doc_id", "node", "n", "first"])

    return docs.mapInArrow(run, "doc_id long, node long, n long, first binary")


def common_shingles(firsts: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes that stand in the beginnings of over one in ``COMMON`` rows: at
    most ``COMMON`` times the mean length of a beginning.

    A task counts exactly in runs of about ``A_RUN`` hashes, and hands on what is
    common in a run; what is common in all is common in some run.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def flush() -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            often = (times * COMMON > texts) & (times > 3)
            return pa.RecordBatch.from_arrays([pa.array(hashes[often]), pa.array(times[often])], names=["shingle", "times"])

        for part in parts(batches):
            held += unpacked(part.column(0))
            size, texts = size + sum(map(len, held[-part.num_rows :])), texts + part.num_rows
            if size >= A_RUN:
                yield flush()
                held, size, texts = [], 0, 0
        if size:
            yield flush()

    found = firsts.mapInArrow(counted, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    found = found.where(F.col("times") * COMMON > rows).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy())


def held_in(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x the sorted array holds."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def shared_counts(prints: DataFrame, common: np.ndarray) -> DataFrame:
    """``node`` and ``shared``: how many of its first shingles begin another set too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # copies in one task are dealt once
        for part in parts(batches):
            new = []
            for k, node in enumerate(part.column(0).to_pylist()):
                if node not in met:
                    if len(met) > 1 << 18:
                        met.clear()
                    met.add(node)
                    new.append(k)
            if new:
                part = part.take(pa.array(new, pa.int64()))
                first = unpacked(part.column(1))
                hashes = np.concatenate(first)
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in first])
                rare = ~held_in(common, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[rare]), pa.array(nodes[rare])], names=["shingle", "node"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle and node of the row before, and whether its run is shared
        for batch in batches:
            h, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(h):
                continue
            new = np.concatenate([[last is None or (h[0], v[0]) != last[:2]], (h[1:] != h[:-1]) | (v[1:] != v[:-1])])
            h, v = h[new], v[new]
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            length = np.diff(np.append(starts, len(h)))
            many = np.repeat(length > 1, length)
            goes_on = last is not None and h[0] == last[0]
            if goes_on:
                many[: length[0]] = True
            found = v[many]
            if goes_on and not last[2]:
                found = np.append(found, last[1])
            last = (h[-1], v[-1], bool(many[-1]))
            nodes, times = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(times)], names=["node", "shared"])

    dealt = prints.select("node", "first").mapInArrow(deal, "shingle long, node long")
    sorted_ = dealt.repartition("shingle").sortWithinPartitions("shingle", "node")
    return sorted_.mapInArrow(fold, "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))


def with_partners(prints: DataFrame, similarity: float) -> DataFrame:
    """Nodes (``node``, ``rep``, ``n``) that may be similar to another."""
    rows = prints.count()
    common = common_shingles(prints.select("first"), rows)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [int(held_in(common, x).sum()) for x in unpacked(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(known, pa.int64())], names=["node", "doc_id", "n", "known"])

    own = prints.select("node", "doc_id", "n", "first").mapInArrow(apart, "node long, doc_id long, n long, known long")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("known").alias("known"))
    need = F.greatest(F.lit(1), F.floor(F.col("n") * (similarity * SPARE) + 1e-6))
    shared = nodes.join(shared_counts(prints, common), "node", "left")
    return shared.where(F.coalesce("shared", F.lit(0)) + F.col("known") >= need).select("node", "rep", "n")


def frequency_order(sets: DataFrame, at_least: int = 4, at_most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that some task finds in ``at_least`` sets, the most frequent
    ``at_most`` of them, and their places by frequency.  Any order is right: it
    decides only how many pairs are verified."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= at_least
            return pa.RecordBatch.from_arrays([pa.array(hashes[often]), pa.array(times[often])], names=["shingle", "times"])

        for part in parts(batches):
            held += unpacked(part.column(0))
            size += sum(map(len, held[-part.num_rows :]))
            if size >= A_RUN:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    every = sets.select("shingles").mapInArrow(counted, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = every.orderBy(F.desc("times"), "shingle").limit(at_most).toArrow()
    shingle, times = (top.column(k).to_numpy() for k in (0, 1))
    rank = np.empty(len(shingle), np.int64)
    rank[np.lexsort((shingle, times))] = np.arange(1, len(shingle) + 1)
    order = np.argsort(shingle)
    return shingle[order], rank[order]


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``node``, ``n`` and ``prefix``: the first shingles, the frequent last."""
    frequent, rank = frequency_order(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets, out = unpacked(batch.column(1)), []
            for x in sets:
                place = np.zeros(len(x), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    place = np.where(frequent[at] == x, rank[at], 0)
                out.append(x[np.argsort(place, kind="stable")[: len(x) - int(least_overlap(len(x), similarity)) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), packed(out)], names=["node", "n", "prefix"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, prefix binary")


PREFIX_ROWS = "node long, n long, of long, place long, before long, further long, hash long"


def _prefix_rows(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each shingle of each prefix, of those that a broadcast filter holds;
    ``before`` and ``further`` are the two shingles before it in the order (before
    the first: the node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared and shared.value and sketch.Filter(*shared.value)
        for batch in parts(batches):
            prefix = unpacked(batch.column(3))
            n = np.array([len(x) for x in prefix])
            hashes = np.concatenate(prefix)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(batch.column(k).to_numpy(), n) for k in range(3)]
            back = lambda k: np.where(place < k, columns[0], np.concatenate([hashes[:k], hashes[:-k]])[: len(hashes)])  # noqa: B023, E731
            columns += [place, back(1), back(2), hashes]
            if held:
                some = held.holds(hashes.view(np.uint64))
                columns = [c[some] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "n", "of", "place", "before", "further", "hash"])

    return run


def prefix_pairs(sized: DataFrame, *, similarity: float, block: int) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of ``node`` in different components ``of_a``, ``of_b``
    that share a shingle of both prefixes and may be similar by size and place.

    A shingle's members beyond ``block`` are dealt to several tasks, and all of them meet
    each part, so a task holds ``block`` of them.
    """
    source = sized.select("node", "n", "of", "prefix")
    mixed = cut(
        source.mapInArrow(_prefix_rows(None), PREFIX_ROWS)
        .groupBy("hash")
        .agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("count"))
        .where("low < high")
        .select("hash", F.ceil(F.col("count") / block).cast("int").alias("blocks"), "count")
    )
    total = mixed.agg(F.sum("count").alias("n")).first()["n"] or 0
    # most shingles stand in one component only, and go no further
    held = sketch.Filter.of(mixed)
    shared = sized.sparkSession.sparkContext.broadcast((held.bits, held.cells) if held else None)
    rows = source.mapInArrow(_prefix_rows(shared), PREFIX_ROWS)
    rows = join_counted(rows, mixed, ["hash"], total=total)
    own = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("role", F.lit(0).cast("byte"))
    met = rows.where("blocks > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1).cast("byte"))
    share = similarity / (1 + similarity)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            hashes, part, role, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(hashes):
                continue
            cuts = np.flatnonzero((hashes[1:] != hashes[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)]):
                now = (hashes[i], part[i])
                if now != last:
                    last, held = now, [c[:0] for c in columns]
                k = i + int(np.searchsorted(role[i:j], 1))
                if k > i:
                    held = [np.concatenate([h, c[i:k]]) for h, c in zip(held, columns)]
                node, n, of, place, before, further = (h[:, None] for h in held)
                step = max(1, CELLS // max(1, len(node)))
                for p in range(i, j, step):
                    node_, n_, of_, place_, before_, further_ = (c[None, p : min(j, p + step)] for c in columns)
                    room = np.minimum(n - place, n_ - place_)  # the overlap, if this is the first shingle shared
                    # a pair that shares a shingle before meets there too, where there is more room
                    met = (before == before_) | (before == further_) | (further == before_) | (further == further_)
                    x, y = np.nonzero((of != of_) & ~met & (room >= share * (n + n_) - 1e-6))
                    if len(x):
                        one, other = (node[x, 0], of[x, 0]), (node_[0, y], of_[0, y])
                        less = one[0] < other[0]
                        found = [np.where(less, u, v) for u, v in ((one[0], other[0]), (other[0], one[0]), (one[1], other[1]), (other[1], one[1]))]
                        new = np.unique(np.stack(found[:2]), axis=1, return_index=True)[1]
                        yield pa.RecordBatch.from_arrays([pa.array(f[new]) for f in found], names=["a", "b", "of_a", "of_b"])

    dealt = own.unionByName(met).repartition("hash", "part").sortWithinPartitions("hash", "part", "role")
    return dealt.select("hash", "part", "role", "node", "n", "of", "place", "before", "further").mapInArrow(fold, "a long, b long, of_a long, of_b long").distinct()


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, among four a shingle or more (a power of two)."""
    size = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[shingles & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """A bound of how many of n and m shingles the sets of two bitmaps share."""
    while len(x) > len(y):  # places are the low bits, so halves fold onto each other
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    ones = lambda z: int(np.bitwise_count(z).sum())
    return ones(x & y) + min(n - ones(x), m - ones(y))


def _in_blocks(pairs: DataFrame, held: DataFrame, block: int, judge: Callable[[pa.Table, pa.Table], np.ndarray]) -> DataFrame:
    """``pairs`` with ``score``, where it is not negative.  What is held of a node is
    dealt to blocks, and a task has that of two blocks for all pairs between
    them: nothing is copied for each pair."""
    names = [c for c in pairs.columns if c != "score"]
    pairs = cut(pairs.select(*names))
    either = lambda *keys: pairs.select(*keys, F.col("a").alias("node")).distinct().unionByName(pairs.select(*keys, F.col("b").alias("node")).distinct()).distinct()
    ends = cut(either())
    # at most `block` nodes a block where pairs are dense, as many pairs a task where they are not
    blocks = max(1, math.ceil(min(ends.count() / block, math.sqrt(pairs.count() / block))))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    key = of("a") * blocks + of("b")
    keyed, wanted = pairs.withColumn("key", key), either(key.alias("of_pair"))
    needed = wanted.join(only(held, ends, "node"), "node")

    def verify(pairs: pa.Table, held: pa.Table) -> pa.Table:
        score = judge(pairs, held)
        return pairs.select(names).append_column("score", pa.array(score, pa.float64())).filter(pa.array(score >= 0))

    schema = ", ".join(f"{c} long" for c in names) + ", score double"
    return keyed.groupBy("key").cogroup(needed.groupBy("of_pair")).applyInArrow(verify, schema)


def _places(pairs: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``held`` for both ends of the pairs."""
    ids = held.column("node").to_numpy()
    order = np.argsort(ids)
    return tuple(order[np.searchsorted(ids, pairs.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))


def maybe_similar(pairs: DataFrame, sets: DataFrame, similarity: float, block: int = 4096) -> DataFrame:
    """Pairs whose bitmaps do not rule them out, and by how much."""

    def judge(pairs: pa.Table, held: pa.Table) -> np.ndarray:
        bits = [np.frombuffer(b.as_buffer(), dtype=np.uint8) for b in held.column("bits")]
        n = held.column("n").to_numpy()
        common = np.array([most_common(bits[x], bits[y], int(n[x]), int(n[y])) for x, y in zip(*(p.tolist() for p in _places(pairs, held)))])
        a, b = _places(pairs, held)
        return common - similarity / (1 + similarity) * (n[a] + n[b]) + 1e-6

    return _in_blocks(pairs, sets.select("node", "n", "bits"), block, judge)


def surely_similar(pairs: DataFrame, sets: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """Pairs that are similar by their whole sets."""

    def judge(pairs: pa.Table, held: pa.Table) -> np.ndarray:
        sets = unpacked(held.column("shingles"))
        size = np.array([len(x) for x in sets], dtype=np.int64)
        names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        a, b = _places(pairs, held)
        score = np.full(len(a), -1.0)
        marked = np.zeros(len(names), np.int64)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            own = numbers[begin[x] : begin[x + 1]]
            marked[own] = 1
            common = int(marked[numbers[begin[y] : begin[y + 1]]].sum())
            marked[own] = 0
            if common >= similarity * (size[x] + size[y] - common) - 1e-9:
                score[k] = common
        return score

    return _in_blocks(pairs, sets.select("node", "shingles"), block, judge)


def apart_still(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of different components, which are ``of_a`` and ``of_b``, the lesser first."""
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    one, other = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    return pairs.where(one != other).withColumns({"of_a": F.least(one, other), "of_b": F.greatest(one, other)}).drop("_a", "_b")


def similar_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 30,
    segments: int = 8,
    block: int = 4096,
) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest doc_id that links reach, of every
    row with an id."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(beginnings(own, width, similarity))
    maybe = cut(with_partners(prints, similarity))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # copies in one task are kept once
        for part in parts(batches):
            sets = [shingle_set(t.as_py() or b"", width) for t in part.column(1).cast(pa.binary())]
            nodes, new = node_of(sets), []
            for k, node in enumerate(nodes.tolist()):
                if node not in met:
                    if len(met) > 1 << 18:
                        met.clear()
                    met.add(node)
                    new.append(k)
            sets = [sets[k] for k in new]
            wide = [wide_fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[new]), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([w[k] for w in wide], pa.int64()) for k in (0, 1)),
                 pa.array([bitmap(x) for x in sets], pa.binary()), packed(sets)],
                names=["node", "n", "fp0", "fp1", "bits", "shingles"],
            )

    found = only(own, maybe.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").mapInArrow(
        sets_of, "node long, n long, fp0 long, fp1 long, bits binary, shingles binary"
    )
    # another row of the same id may have another text; rows of several tasks may be equal, which does no harm
    sets = cut(only(found, maybe, "node"))
    offered = links(sets.select("fp0", "fp1", F.col("node").alias("rep")), radius=radius, segments=segments, block=block, words=2, forest=False)
    offered = cut(offered.groupBy("a", "b").agg(F.min("apart").alias("apart")))

    def verified(pairs: DataFrame) -> DataFrame:
        return surely_similar(maybe_similar(pairs, sets, similarity), sets, similarity).select("a", "b")

    # each one's nearest, then, of what that leaves apart, the nearest between two components
    edges = cut(verified(offered.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))))
    found = cut(components(edges))
    for _ in range(ROUNDS):
        between = apart_still(offered, found).groupBy("of_a", "of_b").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p"))
        edges = cut(edges.unionByName(verified(between.select("p.a", "p.b"))))
        found = cut(components(edges))
    sized = prefixes(sets, similarity).join(found, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    pairs = cut(maybe_similar(prefix_pairs(cut(sized), similarity=similarity, block=block), sets, similarity))
    first = pairs.groupBy("of_a", "of_b").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b")
    edges = cut(edges.unionByName(surely_similar(first, sets, similarity).select("a", "b")))
    rest = apart_still(pairs.select("a", "b"), cut(components(edges)))
    edges = edges.unionByName(surely_similar(rest.select("a", "b"), sets, similarity).select("a", "b"))

    # a document of several texts joins them
    several = prints.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("count"))
    rows = prints.count()
    of_several = join_counted(prints.select("doc_id", "node"), cut(several.where("low < high")), ["doc_id"], total=rows)
    edges = edges.unionByName(of_several.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    found = cut(components(edges))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("count")))
    label = nodes.join(found, "node").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("count"))
    linked = join_counted(found, cut(label), ["component"], total=found.count()).select("node", "least")
    named = cut(nodes.join(linked, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"), "count"))
    return join_counted(prints.select("doc_id", "node"), named, ["node"], total=rows).select("doc_id", "component_id")
