"""Semantic markup, and markup converted from word-processor files, to segments.

The tolerant parser runs in an Arrow batch function that returns an array of
blocks a page; ids, orders and evidence are built-in expressions.  No exchange.

Defined cases: null content, content that is no UTF-8, a missing root and invalid
boundary evidence give no segments and an error; the whole content is checked
for UTF-8 (not just a first part); a page without blocks has no segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from prosegauge import fixed
from prosegauge.schema import COVERAGE, error, evidence, segment, support, with_document_fields
from prosegauge.sources import markup

BLOCK = pa.struct([(name, pa.string()) for name in ("text", "role", "tag", "plain_role")])
NEEDS_BOUNDARIES = "Word HTML requires conversion boundary evidence"
BAD_BOUNDARIES = "Invalid Word conversion boundary evidence"


def word_blocks(html: str, boundaries: dict[str, str] | None) -> tuple[list[tuple[str, str, str, str]], str | None]:
    """Blocks with the roles that conversion markers give and, last, those that
    the markup alone gives; or an error."""
    if boundaries is None:
        return [], NEEDS_BOUNDARIES
    if any(not re.fullmatch(fixed.WORD_MARKER, p) or role not in fixed.WORD_ROLES for p, role in boundaries.items()):
        return [], BAD_BOUNDARIES
    markers = {prefix + end: role for prefix, role in boundaries.items() for end in ("_s", "_e")}
    found = markup.blocks(html, roles=markup.marked_elements(html, markers))
    plain = markup.blocks(html)
    if [b[0] for b in found] != [b[0] for b in plain]:
        return [], "Word role association changed extracted text"
    return [(*b, p[1]) for b, p in zip(found, plain)], None


def _page_blocks(html: bytes | str | None, root_id: str | None, converted: bool, boundaries: list | None) -> tuple[list, str | None]:
    if not converted:
        found, wrong = markup.each_page(lambda text: markup.blocks(text, root_id), html)
        return [(*b, b[1]) for b in found], wrong
    text, wrong = markup.each_page(lambda t: [(t, "", "")], html)
    return ([], wrong) if wrong else word_blocks(text[0][0], dict(boundaries) if boundaries is not None else None)


#: Content that is parsed at a time: a worker holds the blocks of so many bytes or rows, however large its batches are.
PART_BYTES, PART_ROWS = 1 << 21, 256


def page_parts(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``PART_BYTES`` of column ``at`` (one page at least)."""
    for batch in batches:
        start, held = 0, 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
            if k > start and (held + size > PART_BYTES or k - start >= PART_ROWS):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def with_blocks(pages: DataFrame, content: str, *, root_id: str | None = None, boundaries: str | None = None) -> DataFrame:
    """``pages`` without ``content``, with ``blocks`` (text, role, tag) and ``blocks_error``.

    ``content`` is a string or binary column, which does not come back from the
    workers; ``boundaries`` names a column of maps from marker to role, for
    pages converted from word-processor files.
    """
    kept = [c for c in pages.columns if c not in ("blocks", "blocks_error")]
    source = pages.select(*kept)
    at, bounds_at = kept.index(content), kept.index(boundaries) if boundaries else None
    back = [k for k in range(len(kept)) if k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in page_parts(batches, at):
            found, errors = [], []
            limits = batch.column(bounds_at).to_pylist() if boundaries else [None] * batch.num_rows
            for page, bounds in zip(batch.column(at), limits):
                got, wrong = _page_blocks(page.as_py(), root_id, bool(boundaries), bounds)
                found.append([dict(zip(("text", "role", "tag", "plain_role"), b)) for b in got])
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in back), pa.array(found, pa.list_(BLOCK)), pa.array(errors, pa.string())],
                names=[*(kept[k] for k in back), "blocks", "blocks_error"],
            )

    schema = StructType([source.schema.fields[k] for k in back])
    blocks = StructType([StructField(f.name, StringType()) for f in BLOCK])
    schema = schema.add("blocks", ArrayType(blocks)).add("blocks_error", StringType())
    return source.mapInArrow(run, schema)


def segments_of(blocks: Column, sha256: Column) -> Column:
    """Array of segments of an array of blocks."""

    def one(b: Column, k: Column) -> Column:
        role, from_word = b["role"], b["role"].isin(*fixed.WORD_ROLES)  # roles that markup alone never gives
        return segment(
            # the id describes the block as the markup alone gives it
            segment_id=F.substring(F.sha2(F.concat_ws(":", sha256, k.cast("string"), b["tag"], b["plain_role"], b["text"]), 256), 1, 24),
            reading_order=k,
            text=b["text"],
            role=F.when(role == "cover_position", "cover").when(role == "metadata", "instruction").otherwise(role),
            role_confidence=F.when(role == "cover_position", "medium").otherwise("high"),
            role_basis=F.when(from_word, F.concat(F.lit("word_structure:"), role)).otherwise(F.concat(F.lit("semantic_html:"), b["tag"])),
            boundary_before=F.lit("paragraph"),
            warnings=F.array().cast("array<string>"),
        )

    return F.transform(blocks, one)


def html_support(content: Column, kind: Column) -> Column:
    """Whether the markup adapter can read a source, with evidence."""
    text = content.cast("string")
    is_text = F.is_valid_utf8(text)
    has_markup = (F.instr(text, "<") > 0) & (F.instr(text, ">") > 0)
    reason = (
        F.when(kind != "html", F.concat(F.lit("Primary artifact kind is "), kind, F.lit(", not html.")))
        .when(~is_text, "Primary HTML artifact is not UTF-8.")
        .when(~has_markup, "Primary artifact has no HTML markup.")
    )
    found = F.when(reason.isNull(), evidence(("utf8_html_markup", "observed", "high"))).otherwise(evidence())
    return support(F.when(reason.isNull(), "supported").otherwise("unsupported"), reason, found)


def html_documents(sources: DataFrame, *, root_id: str | None = None, boundaries: str | None = None) -> DataFrame:
    """Normalized documents of ``sources`` (``content``, ``sha256``)."""
    made = with_blocks(sources.drop("auxiliaries"), "content", root_id=root_id, boundaries=boundaries)
    n = F.size("segments").cast("bigint")
    made = made.withColumn("segments", segments_of(F.col("blocks"), F.col("sha256")))
    zero = F.lit(0).cast("bigint")
    return with_document_fields(
        made,
        page_count=F.lit(0),
        error_pages=F.array(),
        textless_pages=F.array(),
        continuation_pages=F.array(),
        document_warnings=F.array(),
        observed_pdf_metadata=F.create_map(),
        coverage=F.struct(F.lit("complete").alias("status"), n.alias("matched_blocks"), zero.alias("unmatched_blocks"), zero.alias("ambiguous_blocks")).cast(COVERAGE),
        extraction_evidence=evidence(("semantic_html_blocks", n, "high")),
        dependencies=F.create_map(),
        error=error("adapter_contract_error", F.col("blocks_error")),
    ).drop("blocks", "blocks_error")
