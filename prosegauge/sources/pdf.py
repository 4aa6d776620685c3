"""Reading PDF files into the tables that the page operators take.

Needs ``pdfplumber`` and ``pypdf``, which are loaded only when a file is read; without
them ``DependencyError`` is raised before any job starts.  Pages of a file are
read in one task, files in many.  Alignment of line geometry has no need of
them and works on any two lists of lines.

Every file is read once: what was read goes to the shared checkpoint folder.

Defined cases: a file that is missing or cannot be read has empty tables and an
``error``, and never ends the job; a page whose text cannot be read has no lines
and is listed as failed; lines without matching geometry have no box.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosegauge import fixed
from prosegauge.errors import AdapterExecutionError, DependencyError, InputError
from prosegauge.runtime import cut
from prosegauge.schema import BBOX, evidence, support

LIBRARIES = ("pdfplumber", "pypdf")
_BOX = pa.struct([(c, pa.float64()) for c in ("left", "top", "right", "bottom")])


def need_libraries() -> None:
    missing = [x for x in LIBRARIES if importlib.util.find_spec(x) is None]
    if missing:
        raise DependencyError("PDF files need " + " and ".join(missing))


def has_pdf_header(content: Column) -> Column:
    return F.instr(F.substring(content, 1, 1024).cast("string"), "%PDF-") > 0


def pdf_support(content: Column, kind: Column) -> Column:
    """Whether the page adapter can read a source, with evidence."""
    reason = F.when(kind != "pdf", F.concat(F.lit("Primary artifact kind is "), kind, F.lit(", not pdf."))).when(
        ~F.coalesce(has_pdf_header(content), F.lit(False)), "Primary artifact has no PDF header."
    )
    found = F.when(reason.isNull(), evidence(("pdf_header", "observed", "high"))).otherwise(evidence())
    return support(F.when(reason.isNull(), "supported").otherwise("unsupported"), reason, found)


def aligned(lines: list[str], observed: list[str]) -> list[int | None]:
    """For each line the observed line it matches, by longest matching blocks."""
    out: list[int | None] = [None] * len(lines)
    for block in SequenceMatcher(a=lines, b=observed, autojunk=False).get_matching_blocks():
        for k in range(block.size):
            out[block.a + k] = block.b + k
    return out


def align_geometry(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """``lines`` (``doc_id``, ``page``, ``line_index``, ``text``) with the ``bbox`` of
    ``geometry`` (``doc_id``, ``page``, ``k``, ``text``, ``bbox``), page by page."""
    own = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("own"))
    seen = geometry.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("k", "text", F.col("bbox").alias("bbox")))).alias("seen"))
    both = own.join(seen, ["doc_id", "page"], "left").select("doc_id", "page", "own", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = []
            for mine, theirs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                theirs = theirs or []
                at = aligned([x["text"] for x in mine], [x["text"] for x in theirs])
                boxes.append([None if k is None else theirs[k]["bbox"] for k in at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(boxes, pa.list_(_BOX))], names=["doc_id", "page", "own", "boxes"]
            )

    made = both.mapInArrow(run, f"doc_id bigint, page int, own array<struct<line_index:int,text:string>>, boxes array<{BBOX}>")
    rows = made.select("doc_id", "page", F.explode(F.arrays_zip("own", "boxes")).alias("z"))
    return rows.select("doc_id", "page", "z.own.line_index", "z.own.text", F.col("z.boxes").alias("bbox"))


_PAGE_TABLES = {
    "lines": "array<struct<page:int,line_index:int,text:string>>",
    "geometry": f"array<struct<page:int,k:int,text:string,bbox:{BBOX}>>",
    "words": (
        "array<struct<page:int,native_index:int,text:string,left:double,top:double,right:double,bottom:double,"
        "font_name:string,font_size:double,mcid:int,leaf_tag:string>>"
    ),
    "shapes": "array<struct<page:int,left:double,top:double,right:double,bottom:double,filled:boolean>>",
    "annots": "array<struct<page:int,subtype:string,contents:string,left:double,top:double,right:double,bottom:double>>",
    "pages": "array<struct<page:int,width:double,height:double,extraction_failed:boolean>>",
    "tree": "string",
    "metadata": "map<string,string>",
    "error": "struct<code:string,message:string>",
}


def _each_file(read: Callable[[bytes], dict], content: bytes | None) -> dict:
    """What a file holds, or why it cannot be read (in words that name no path)."""
    if content is None:
        return {"error": {"code": InputError.code, "message": "Primary PDF artifact is missing."}}
    try:
        return read(content)
    except Exception as wrong:  # noqa: BLE001  parsers raise whatever they meet
        return {"error": {"code": AdapterExecutionError.code, "message": f"The PDF cannot be read ({type(wrong).__name__})."}}


def read_pages(sources: DataFrame, read: Callable[[bytes], dict] | None = None) -> DataFrame:
    """One row a file: arrays of lines, geometry, words, shapes, annotations and
    pages, the structure tree as JSON, observed metadata, and an error.

    ``read`` makes them of a file's bytes; without one the libraries are used.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if read is None:
        need_libraries()
        # on the driver: what the tasks need is shipped by value
        from prosegauge.sources.pdf_files import read_file as read

    schema = StructType.fromDDL("doc_id bigint, " + ", ".join(f"{n} {t}" for n, t in _PAGE_TABLES.items()))
    arrow_schema = to_arrow_schema(schema)
    empty = {n: [] for n, t in _PAGE_TABLES.items() if t.startswith("array")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(*(batch.column(k) for k in (0, 1))):
                row = {"doc_id": doc.as_py()} | empty | _each_file(read, content.as_py())
                yield pa.RecordBatch.from_pylist([row], schema=arrow_schema)

    return cut(sources.select("doc_id", "content").mapInArrow(run, schema))


def page_table(files: DataFrame, name: str) -> DataFrame:
    """One of the arrays of ``read_pages`` as rows."""
    return files.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")


def observed_metadata(found: dict) -> dict[str, str]:
    names = {str(k).lstrip("/"): v for k, v in (found or {}).items()}
    return {n: str(names[n]) for n in fixed.OBSERVED_PDF_METADATA if names.get(n) is not None}
