"""Lines of flat pages: repeated edges, roles and segments.

``lines`` tables have ``doc_id``, ``page``, ``line_index`` (from 0), ``text`` and,
optionally, ``bbox``.  Edges are found with one aggregation by document; roles
are one ordered CASE over pattern predicates.

Defined cases: blank lines are dropped and the others renumbered; a document
without lines has no segments; null texts count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions import lines as L
from prosegauge.schema import BBOX, segment

EDGE_METHOD = "repeated-edge@1.0.0"
BASES = {
    "number": "page-number-pattern@1.0.0",
    "contents": "dot-leader-pattern@1.0.0",
    "list": "list-prefix-pattern@1.2.0",
    "heading": "bounded-heading-shape@1.0.0",
    "cover": "first-page-position@1.0.0",
    "body": "pdf-line-default@1.0.0",
}


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines with white space normalized, blank ones gone and numbers closed up."""
    kept = lines.withColumn("text", L.normalized(F.col("text"))).where("text <> ''")
    order = Window.partitionBy("doc_id", "page").orderBy("line_index")
    return kept.withColumn("line_index", (F.row_number().over(order) - 1).cast("int"))


def with_line_counts(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line_count", F.count("*").over(Window.partitionBy("doc_id", "page")).cast("int"))


def is_page_edge(index: Column, line_count: Column, edge_lines: int) -> Column:
    return (index < edge_lines) | (index >= F.greatest(F.lit(0), line_count - edge_lines))


def repeated_edges(
    lines: DataFrame,
    page_counts: DataFrame | None = None,
    *,
    edge_lines: int = 3,
    min_pages: int = fixed.EDGE_MIN_PAGES,
    min_share: float = fixed.EDGE_PAGE_SHARE,
) -> DataFrame:
    """``doc_id``, ``pattern`` and ``pages`` of edge lines that recur on enough pages.

    The same line counts once a page (lines that only become equal by
    normalization count each).  ``page_counts`` (``doc_id``, ``page_count``)
    is needed where pages without lines count too.
    """
    edges = with_line_counts(lines).where(is_page_edge(F.col("line_index"), F.col("line_count"), edge_lines))
    keys = edges.select("doc_id", "page", "text").distinct().select("doc_id", L.edge_key(F.col("text")).alias("pattern"))
    keys = keys.where(F.length("pattern").between(fixed.EDGE_MIN_CHARS, fixed.EDGE_MAX_CHARS))
    counts = keys.groupBy("doc_id", "pattern").agg(F.count("*").alias("pages"))
    if page_counts is None:
        page_counts = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("page_count"))
    enough = F.greatest(F.lit(min_pages), F.ceil(F.col("page_count") * F.lit(min_share)))
    return counts.join(page_counts, "doc_id").where(F.col("pages") >= enough).select("doc_id", "pattern", "pages")


def line_role(text: Column, page: Column, index: Column, line_count: Column, repeated: Column) -> Column:
    """Struct ``role``, ``confidence``, ``basis``; the first that holds."""

    def found(role: str, confidence: str, basis: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"))

    edge = repeated & is_page_edge(index, line_count, 1)
    return (
        F.when(edge & (index < 1), found("header", "high", EDGE_METHOD))
        .when(edge, found("footer", "high", EDGE_METHOD))
        .when(L.is_page_number(text), found("navigation", "high", BASES["number"]))
        .when(L.is_contents_line(text), found("table_of_contents", "high", BASES["contents"]))
        .when(L.is_list_line(text), found("list", "high", BASES["list"]))
        .when(L.is_heading_shape(text), found("heading", "medium", BASES["heading"]))
        .when((page == 1) & (index < fixed.COVER_LINES), found("cover", "low", BASES["cover"]))
        .otherwise(found("body", "low", BASES["body"]))
    )


def classified_lines(lines: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``line_count`` and ``found`` (role, confidence, basis)."""
    edges = repeated_edges(lines, page_counts, edge_lines=1).select("doc_id", F.col("pattern").alias("_key"), F.lit(True).alias("_repeated"))
    # only edges can be repeated; no pattern holds the digits by which the other lines are spread
    counted = with_line_counts(lines)
    at_edge = is_page_edge(F.col("line_index"), F.col("line_count"), 1)
    keyed = counted.withColumn("_key", F.when(at_edge, L.edge_key(F.col("text"))).otherwise(F.concat(F.lit("\0"), F.col("page").cast("string"))))
    joined = keyed.join(edges, ["doc_id", "_key"], "left")
    role = line_role(F.col("text"), F.col("page"), F.col("line_index"), F.col("line_count"), F.coalesce("_repeated", F.lit(False)))
    return joined.withColumn("found", role).drop("_key", "_repeated")


def line_segments(lines: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """Segments, one a line, in page and line order (numbered from 1)."""
    rows = classified_lines(lines, page_counts)
    bbox = F.col("bbox") if "bbox" in rows.columns else F.lit(None)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_index"))
    made = segment(
        segment_id=F.format_string("p%04d-l%04d", F.col("page"), F.col("line_index") + 1),
        reading_order=order,
        text=F.col("text"),
        page=F.col("page"),
        bbox=bbox.cast(BBOX),
        role=F.col("found.role"),
        role_confidence=F.col("found.confidence"),
        role_basis=F.col("found.basis"),
        boundary_before=F.when(F.col("line_index") == 0, "page").otherwise("line"),
        warnings=F.array().cast("array<string>"),
    )
    return rows.select("doc_id", made.alias("s")).select("doc_id", "s.*")
