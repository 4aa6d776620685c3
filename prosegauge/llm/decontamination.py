"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` (13) consecutive words of a benchmark item; an item of
fewer words, but not none, is one window.  Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.

Winnowing: a window of 13 words has ten 4-grams; its fingerprint is the least of
their hashes, so equal windows have equal fingerprints wherever they stand, and
neighbouring windows mostly share one.

1. Each text keeps its distinct fingerprints, one for each run of windows that share it.
   They meet the benchmark's; most texts end here.
2. Only in texts that hold a fingerprint of the benchmark, and only around it, are
   hits extended to whole windows: a window counts if the hash of all 13 words is equal
   too (128 bits with the fingerprint).  Every shared span of 13 or more words is found.

Items of fewer words than a window are found likewise by the hash of their first
word and then of the whole.

Shifted arrays are combined pairwise (1, 2, 4, 8 words), so a window's hashes
cost a fixed number of steps a word.  Benchmark fingerprints are broadcast while
there are at most ``broadcast_windows`` windows, which are counted; beyond that the two
sides meet by an exchange on the fingerprint and a salt, so that a fingerprint
that a third of all texts hold is dealt to many tasks.

Texts are known by 128 bits of hash, so results belong to a text, not to an id.
Items that hold the same windows are kept as one set, which hits name by its hash.

Defined cases: null and empty texts have no words, no hits and the digest of the
empty string; documents shorter than the window can only be hit by short items;
repeated item rows count once; items with a null id are ignored; rows that repeat
a ``doc_id``, or have none, are judged one by one by their own text; no benchmark
rows: no hits; empty documents: empty result; further columns are carried through
unless they bear a name of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.joins import only
from prosegauge.runtime import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 4
SALTS = 16
TEXT = ["k1", "k2"]
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_full")


def words(text: Column) -> Column:
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK)
    return F.array_remove(split, "")


def _both(a: str, b: str, shift: int, count: Column, f) -> Column:
    """f(a[i], b[i + shift]) for the first ``count`` i."""
    return F.zip_with(F.slice(a, 1, count), F.slice(b, 1 + shift, count), f)


def with_windows(df: DataFrame, *, whole: bool) -> DataFrame:
    """From ``words``: the array ``fingerprint`` of all windows, and ``whole`` if wanted.

    Every step is a projection of its own: a step's array is read many times
    by the next and must not be computed anew for each element.
    """
    others = df.columns
    n = F.size("words")
    some = lambda less: F.greatest(n - less, F.lit(0))
    pair = lambda x, y: F.xxhash64(x, y)
    least = lambda x, y: F.least(x, y)
    long_ = lambda c: [c] if whole else []
    h = df.select(*others, F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    h = h.select(*others, "h1", _both("h1", "h1", 1, some(1), pair).alias("h2"))
    h = h.select(*others, *long_("h1"), _both("h2", "h2", 2, some(3), pair).alias("h4"))
    h = h.select(*others, *long_("h1"), *long_("h4"), *long_(_both("h4", "h4", 4, some(7), pair).alias("h8")), _both("h4", "h4", 1, some(4), least).alias("m2"))
    h = h.select(*others, *long_("h1"), *long_(_both("h8", "h4", 8, some(11), pair).alias("h12")), _both("m2", "m2", 2, some(6), least).alias("m4"))
    h = h.select(*others, *long_(_both("h12", "h1", 12, some(12), pair).alias("whole")), _both("m4", "m4", 4, some(10), least).alias("m8"))
    return h.select(*others, *long_("whole"), _both("m8", "m8", 2, some(12), least).alias("fingerprint"))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id``, ``length``, ``fingerprint`` and ``whole`` of each window of an item."""
    n = F.size("words")
    full = with_windows(items.where(n >= WINDOW), whole=True).select("item_id", F.explode(F.arrays_zip("fingerprint", "whole")).alias("w"))
    short = items.where((n > 0) & (n < WINDOW)).select(
        "item_id", n.alias("length"), F.xxhash64(F.get("words", F.lit(0))).alias("fingerprint"), F.xxhash64("words").alias("whole")
    )
    return full.select("item_id", F.lit(WINDOW).alias("length"), "w.fingerprint", "w.whole").unionByName(short)


def hits(texts: DataFrame, items: DataFrame, *, broadcast_windows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """``k1``, ``k2``, ``start``, ``length`` and ``of`` of each window of an item that
    occurs in a text; and the sets ``of`` with their ``items`` (ids as strings).

    texts: ``k1``, ``k2`` and ``words``; items: ``item_id``, ``words``.
    """
    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "words")
    windows = item_windows(own).groupBy("length", "fingerprint", "whole").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = cut(windows.withColumn("of", F.xxhash64("items")))
    sets = windows.dropDuplicates(["of"]).select("of", "items")
    filed = windows.select("length", "fingerprint", "whole", "of")
    prints = filed.select("fingerprint").distinct()
    shortest = sorted(r["length"] for r in filed.select("length").distinct().where(f"length < {WINDOW}").collect())
    bounded = filed.count() <= broadcast_windows

    # 1: which texts hold which fingerprints
    held = with_windows(texts, whole=False)
    keys = F.array_distinct("fingerprint")
    if shortest:
        keys = F.array_union(keys, F.transform("words", lambda w: F.xxhash64(w)))
    sent = held.select(*TEXT, F.explode(keys).alias("fingerprint"))
    if bounded:
        met = sent.join(F.broadcast(prints), "fingerprint", "left_semi")
    else:
        salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = sent.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["fingerprint", "salt"], "left_semi")
    near = cut(met.groupBy(*TEXT).agg(F.collect_set("fingerprint").alias("held")))

    # 2: windows around them
    whole = with_windows(only(texts, near, *TEXT).dropDuplicates(TEXT).join(near, TEXT), whole=True)
    window = lambda i: F.struct(
        i.alias("start"), F.lit(WINDOW).alias("length"), F.get("fingerprint", i).alias("fingerprint"), F.get("whole", i).alias("whole")
    )
    kind = "array<struct<start:int,length:int,fingerprint:bigint,whole:bigint>>"
    places = F.filter(F.transform("fingerprint", lambda x, i: F.when(F.array_contains("held", x), i)), lambda i: i.isNotNull())
    found = F.transform(places, window).cast(kind)
    if shortest:
        n = F.size("words")
        short = F.flatten(
            F.transform(
                F.array(*map(F.lit, shortest)),
                lambda k: F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
                        lambda i: (i + k <= n) & F.array_contains("held", F.xxhash64(F.get("words", i))),
                    ),
                    lambda i: F.struct(
                        i.alias("start"), k.alias("length"), F.xxhash64(F.get("words", i)).alias("fingerprint"), F.xxhash64(F.slice("words", i + 1, k)).alias("whole")
                    ),
                ),
            )
        )
        found = F.concat(found, short.cast(kind))
    rows = whole.select(*TEXT, F.explode(found).alias("w")).select(*TEXT, "w.*")
    return rows.join(F.broadcast(filed) if bounded else filed, ["length", "fingerprint", "whole"]).select(*TEXT, "start", "length", "of"), sets


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    one_in: int = 20,
    broadcast_windows: int = 500_000,
    broadcast_texts: int = 100_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` (some word is hit, and at least one in ``one_in``) and ``n_full``
    (words hit by windows of items that are not short)."""
    kept = [c for c in docs.columns if c not in RESULT]
    text = F.col(text_col)
    numbered = [F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]  # names that cannot clash
    own = docs.select(*numbered, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), words(text).alias("words"))
    theirs = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words"))
    rows, sets = hits(own.select(*TEXT, "words"), theirs, broadcast_windows=broadcast_windows)
    found = cut(
        rows.groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("of").alias("sets"))
    )
    named = found.select(*TEXT, F.explode("sets").alias("of")).join(sets, "of").groupBy(*TEXT).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = cut(
        found.join(named, TEXT).select(
            *TEXT,
            _covered(F.col("spans")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            _covered(F.filter("spans", lambda s: s["length"] == WINDOW)).alias("n_full"),
        )
    )
    few = counted.count() <= broadcast_texts
    zero = F.lit(0).cast("long")
    n_words, n_hit = F.size("words").cast("long"), F.coalesce("n_hit", zero)
    return own.join(F.broadcast(counted) if few else counted, TEXT, "left").select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)],
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= n_words)).alias("contaminated"),
        F.coalesce("n_full", zero).alias("n_full"),
    )
