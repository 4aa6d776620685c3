"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed pseudo-random place in its source: the 48 leading
bits of ``md5(id)``, or of its text's where there is no id.  A source that must supply a fraction of
its words takes the documents below a threshold of that hash, so a larger
budget always takes a superset of a smaller one, and nothing is sorted:

1. words by source and leading 12 hash bits (a histogram of 4,096 buckets);
2. running totals over the buckets give the bucket in which the budget ends;
3. only documents of that one bucket are looked at again, by the next 18 bits
   and the last 18, until the bucket is a single hash value;
4. ``filter`` by hash below the threshold.

Targets: words are shared by weight; a target above ``max_repeats`` times its
source is cut to that and the excess is shared again by weight among the rest
until no target is above.  A target over the source's size takes every document
``floor(target / size)`` times and the remainder by threshold.  The document at
the threshold is taken if that brings the source nearer to its target.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; repeated rows are separate documents with the same place; documents without
an id are placed by their text; documents of size 0 take 0 words; an empty table gives an empty table; further columns are
carried through unless they bear a name of the result.

Only DataFrame functions are used; the driver holds one row for each source at
most of which ``max_sources`` are accepted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.runtime import cut

SPLITS = (12, 18, 18)
RESULT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(blank, " "), "")), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """48 pseudo-random bits of a document's id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long")


def share_targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets by weight, none above ``most`` times its size."""
    targets = [0.0] * len(sizes)
    open_, rest = set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[k] for k in sorted(open_))
        over = [k for k in sorted(open_) if rest * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = rest * weights[k] / weight
            break
        for k in over:
            targets[k] = most * sizes[k]
            rest -= targets[k]
            open_.discard(k)
    return targets


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_repeats: int = 3,
    max_sources: int = 100_000,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``weights`` repeat over the sources in code point order; the mix holds
    ``share`` of all words.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in RESULT]
    at = place(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text_col, F.lit(""))))))
    left = 48 - SPLITS[0]
    placed = docs.select(F.col(source_col).alias("src"), F.col(text_col).alias("text"), at.alias("_place"))
    cells = cut(
        placed.select("src", word_count(F.col("text")).alias("size"), F.shiftright("_place", left).alias("cell"))
        .groupBy("src", "cell")
        .agg(F.sum("size").alias("words"))
    )
    totals = [
        (r["src"], int(r["words"]))
        for r in cells.groupBy("src").agg(F.sum("words").alias("words")).orderBy(F.col("src").asc_nulls_last()).take(max_sources + 1)
    ]
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [n for _, n in totals]
    targets = share_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), max_repeats)
    plan = []
    for (src, n), target in zip(totals, targets):
        whole = min(max_repeats, int(target // n)) if n else 0
        plan.append((src, n, float(target), whole, float(target - whole * n)))
    budgets = spark.createDataFrame(plan, "src string, source_size long, target double, whole int, budget double")

    found = _boundary(cells, budgets)
    for bits in SPLITS[1:]:
        left, before = left - bits, left
        ends = F.broadcast(found.select(F.col("src").alias("_src"), "prefix"))
        inside = placed.join(
            ends, placed["src"].eqNullSafe(F.col("_src")) & (F.shiftright("_place", before) == F.col("prefix"))
        ).select("src", word_count(F.col("text")).alias("size"), F.shiftright("_place", left).alias("cell"))
        found = cut(_boundary(inside.groupBy("src", "cell").agg(F.sum("size").alias("words")), found.drop("prefix", "inside")))
    cut_at = found.select("src", "source_size", "target", "whole", F.col("prefix").alias("_cut"), (F.col("inside") - 2 * F.col("budget") <= 0).alias("_take"))
    # the boundary is one hash value now; its documents, nearly always one, are taken if that is nearer
    sized = docs.select(*kept, word_count(F.col(text_col)).alias("size"), at.alias("_place"))
    joined = sized.join(F.broadcast(cut_at), sized[source_col].eqNullSafe(cut_at["src"]))
    extra = (F.col("_place") < F.col("_cut")) | ((F.col("_place") == F.col("_cut")) & F.col("_take"))
    times = F.least(F.lit(max_repeats), F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int"))
    return joined.select(
        *[sized[c] for c in kept], "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken")
    )


def _boundary(cells: DataFrame, budgets: DataFrame) -> DataFrame:
    """The cell of each source in which its budget ends, and what of the
    budget is left there; sources whose budget covers all have no cell."""
    running = F.sum("words").over(Window.partitionBy("src").orderBy("cell"))
    ends = cells.withColumn("before", running - F.col("words")).withColumnRenamed("src", "_src")
    joined = budgets.join(
        ends, ends["_src"].eqNullSafe(budgets["src"]) & (F.col("before") < F.col("budget")), "left"
    )
    last = joined.groupBy("src", "source_size", "target", "whole", "budget").agg(
        F.max(F.struct("cell", "before", "words")).alias("at")
    )
    return last.select(
        "src",
        "source_size",
        "target",
        "whole",
        F.col("at.cell").alias("prefix"),
        (F.col("budget") - F.col("at.before")).alias("budget"),
        F.col("at.words").alias("inside"),
    )
