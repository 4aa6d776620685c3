"""Schemas of the tables that stages hand to each other.

``segments`` is the central one: an ordered list of role-labelled pieces of text a
document, as an array column on the hot path (one row a document, no shuffle) or
exploded where a view or a page-level stage wants rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBOX = "struct<left:double,top:double,right:double,bottom:double>"
SEGMENT_FIELDS = (
    ("segment_id", "string"),
    ("reading_order", "int"),
    ("text", "string"),
    ("page", "int"),
    ("bbox", BBOX),
    ("role", "string"),
    ("role_confidence", "string"),
    ("role_basis", "string"),
    ("boundary_before", "string"),
    ("warnings", "array<string>"),
    ("inclusion_override", "boolean"),
)
SEGMENT = "struct<" + ",".join(f"{n}:{t}" for n, t in SEGMENT_FIELDS) + ">"
EVIDENCE = "array<struct<code:string,value:string,confidence:string>>"
COVERAGE = "struct<status:string,matched_blocks:bigint,unmatched_blocks:bigint,ambiguous_blocks:bigint>"

#: What an adapter hands to the engine, besides the columns of its sources.
DOCUMENT_FIELDS = (
    ("segments", f"array<{SEGMENT}>"),
    ("page_count", "int"),
    ("error_pages", "array<int>"),
    ("textless_pages", "array<int>"),
    ("continuation_pages", "array<int>"),
    ("document_warnings", "array<string>"),
    ("observed_pdf_metadata", "map<string,string>"),
    ("coverage", COVERAGE),
    ("support", f"struct<status:string,evidence:{EVIDENCE},reason:string>"),
    ("extraction_evidence", EVIDENCE),
    ("dependencies", "map<string,string>"),
    # null: the primary artifact, and all that the adapter declares
    ("artifacts_consumed", "array<string>"),
    ("capabilities_used", "array<string>"),
    ("error", "struct<code:string,message:string>"),
)

PDF_LINES = f"doc_id bigint, page int, line_index int, text string, bbox {BBOX}"
PDF_PAGES = "doc_id bigint, page int, width double, height double, extraction_failed boolean"
PDF_WORDS = (
    "doc_id bigint, page int, native_index int, text string, left double, top double, right double, bottom double,"
    " font_name string, font_size double, mcid int, leaf_tag string"
)
PDF_TAGS = "doc_id bigint, page int, mcid int, rank int, tag_path array<string>, group_id string, group_tag string, cell_id string"
PDF_SHAPES = "doc_id bigint, page int, left double, top double, right double, bottom double, filled boolean"
PDF_ANNOTS = "doc_id bigint, page int, subtype string, contents string, left double, top double, right double, bottom double"


def segment(**fields) -> Column:
    """A segment struct; what is not given is null."""
    unknown = fields.keys() - {n for n, _ in SEGMENT_FIELDS}
    if unknown:
        raise TypeError(f"no such segment fields: {sorted(unknown)}")
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in SEGMENT_FIELDS])


def exploded(documents: DataFrame, *keep: str) -> DataFrame:
    """One row a segment, with ``keep`` columns of the document."""
    return documents.select(*keep, F.explode("segments").alias("s")).select(*keep, "s.*")


def gathered_segments(columns: list[str]) -> Column:
    """Aggregate: an array of segments in reading order, of rows with these columns."""
    row = segment(**{n: F.col(n) for n, _ in SEGMENT_FIELDS if n in columns})
    ordered = F.array_sort(F.collect_list(F.struct(F.col("reading_order").cast("int").alias("k"), row.alias("s"))), lambda a, b: a["k"] - b["k"])
    return F.transform(ordered, lambda x: x["s"])


def gathered(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """The reverse of ``exploded``: segments in reading order, a row a document."""
    return segments.groupBy(key).agg(gathered_segments(segments.columns).alias("segments"))


def evidence(*items: tuple[str, Column | str, str]) -> Column:
    if not items:
        return F.array().cast(EVIDENCE)
    made = [
        F.struct(
            F.lit(code).alias("code"),
            (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"),
            F.lit(confidence).alias("confidence"),
        )
        for code, value, confidence in items
    ]
    return F.array(*made).cast(EVIDENCE)


def support(status: Column, reason: Column, found: Column) -> Column:
    return F.struct(status.alias("status"), found.alias("evidence"), reason.alias("reason"))


def error(code: str, message: Column) -> Column:
    """A struct, or null where the message is null."""
    return F.when(message.isNotNull(), F.struct(F.lit(code).alias("code"), message.alias("message")))


def with_document_fields(df: DataFrame, **given: Column) -> DataFrame:
    """``df`` with every field an adapter must hand over; null where not given."""
    return df.withColumns({n: given.get(n, F.lit(None)).cast(t) for n, t in DOCUMENT_FIELDS if n in given or n not in df.columns})
