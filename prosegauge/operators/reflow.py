"""Paragraphs of flat pages: visually continuous lines are joined.

A line begins a block unless page, role and geometry say that it continues the one
before it; that needs the previous line alone (``lag``), and blocks are the
islands between beginnings.  Nothing is reordered or joined across pages.

Defined cases: lines without geometry begin blocks; pages without line heights
take a fixed height; no lines, no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import half_even, strip
from prosegauge.schema import segment

METHOD = "flat-pdf-paragraph-reconstruction@0.1.0"


def boundary_reason(before: Column, row: Column, height: Column) -> Column:
    """Why a line does not continue the one before (or ``continuation``).

    ``before`` and ``row`` are structs ``page``, ``role``, ``bbox``.
    """
    starts = row["role"].isin(*fixed.BLOCK_START_ROLES) | before["role"].isin(*fixed.BLOCK_START_ROLES)
    above, box = before["bbox"], row["bbox"]
    after_list = (before["role"] == "list") & (row["role"] == "body")
    shift = F.abs(box["left"] - above["left"])
    gap = box["top"] - above["bottom"]
    return (
        F.when(~row["page"].eqNullSafe(before["page"]), "page")
        .when(row["role"] == "list", "list_item")
        .when(starts, "structural_role")
        .when(above.isNull() | box.isNull(), "missing_geometry")
        .when(shift > F.when(after_list, fixed.LIST_SHIFT_LIMIT).otherwise(fixed.SHIFT_LIMIT), "horizontal_shift")
        .when(gap < -(F.lit(fixed.OVERLAP_SHARE) * height), "overlapping_or_reordered_lines")
        .when(gap > F.greatest(F.lit(fixed.GAP_POINTS), F.lit(fixed.GAP_SHARE) * height), "vertical_gap")
        .otherwise("continuation")
    )


def with_reasons(lines: DataFrame) -> DataFrame:
    """Line segments with ``reason`` and the number of their ``block``."""
    of_page = Window.partitionBy("doc_id", "page")
    in_order = Window.partitionBy("doc_id").orderBy("reading_order")
    own = F.col("bbox.bottom") - F.col("bbox.top")
    # pages without numbers have no typical height
    median = F.when(F.col("page").isNotNull(), F.median(F.when(own > 0, own)).over(of_page))
    height = F.coalesce(median, F.lit(fixed.DEFAULT_LINE_HEIGHT))
    rows = lines.withColumn("_height", height).withColumn("_row", F.struct("page", "role", "bbox"))
    rows = rows.withColumn("_before", F.lag("_row").over(in_order))
    reason = F.when(F.col("_before").isNull(), "document_start").otherwise(boundary_reason(F.col("_before"), F.col("_row"), F.col("_height")))
    rows = rows.withColumn("reason", reason)
    block = F.sum(F.when(F.col("reason") == "continuation", 0).otherwise(1)).over(in_order).cast("int")
    return rows.withColumn("block", block).drop("_height", "_row", "_before")


REASONS = (
    "continuation", "document_start", "horizontal_shift", "list_item", "missing_geometry", "overlapping_or_reordered_lines", "page", "structural_role", "vertical_gap",
)


def joined_blocks(lines: DataFrame) -> DataFrame:
    """Segments of the joined blocks, with the ``lines`` of each, those ``placed``, and the
    ``reason`` of its first."""
    by_order = lambda a, b: a["reading_order"] - b["reading_order"]
    fields = F.struct("reading_order", "text", "page", "role", "role_confidence", "role_basis", "bbox")
    rows = with_reasons(lines).groupBy("doc_id", "block").agg(
        F.array_sort(F.collect_list(fields), by_order).alias("rows"),
        F.countDistinct("role").alias("roles"),
        F.min("bbox.left").alias("left"),
        F.min("bbox.top").alias("top"),
        F.max("bbox.right").alias("right"),
        F.max("bbox.bottom").alias("bottom"),
        F.count("*").alias("lines"),
        F.count("bbox").alias("placed"),
        F.min_by("reason", "reading_order").alias("reason"),
    )
    first, mixed = F.col("rows")[0], F.col("roles") > 1
    made = segment(
        segment_id=F.format_string("flat-pdf-block-%05d", F.col("block")),
        reading_order=F.col("block"),
        text=F.array_join(F.transform("rows", lambda r: strip(r["text"])), " "),
        page=first["page"],
        bbox=F.when(F.col("placed") == F.col("lines"), F.struct("left", "top", "right", "bottom")),
        role=first["role"],
        role_confidence=F.when(mixed, "low").otherwise(first["role_confidence"]),
        role_basis=F.when(mixed, METHOD).otherwise(first["role_basis"]),
        boundary_before=F.when(F.col("block") == 1, "page").otherwise("paragraph"),
        warnings=F.array().cast("array<string>"),
    )
    return rows.select("doc_id", made.alias("s"), "lines", "placed", "reason").select("doc_id", "s.*", "lines", "placed", "reason")


def reflow(lines: DataFrame) -> DataFrame:
    """Segments of the joined blocks."""
    return joined_blocks(lines).drop("lines", "placed", "reason")


def reflow_facts() -> Column:
    """Aggregate of ``joined_blocks``: the columns of ``reflow_diagnostics`` as a struct."""
    n, placed = F.sum("lines"), F.sum("placed")
    of = lambda r: n - F.count("*") if r == "continuation" else F.count_if(F.col("reason") == r)
    counts = F.array(*[F.struct(F.lit(r).alias("reason"), of(r).cast("bigint").alias("n")) for r in REASONS])
    return F.struct(
        F.max("reading_order").cast("long").alias("paragraph_count"),
        n.alias("source_line_count"),
        placed.alias("geometry_line_count"),
        half_even(placed / n, 6).alias("geometry_coverage"),
        F.map_from_entries(F.filter(counts, lambda c: c["n"] > 0)).alias("decision_counts"),
    )


def reflow_diagnostics(lines: DataFrame) -> DataFrame:
    """Per document: blocks, lines, lines with geometry, their share (6 decimals)
    and how often each reason was given."""
    rows = with_reasons(lines)
    by_reason = rows.groupBy("doc_id", "reason").agg(
        F.count("*").alias("n"), F.count("bbox").alias("placed"), F.max("block").alias("last")
    )
    return by_reason.groupBy("doc_id").agg(
        F.max("last").cast("long").alias("paragraph_count"),
        F.sum("n").alias("source_line_count"),
        F.sum("placed").alias("geometry_line_count"),
        half_even(F.sum("placed") / F.sum("n"), 6).alias("geometry_coverage"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("decision_counts"),
    )
