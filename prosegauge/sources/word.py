"""Front matter of word-processor documents, before their conversion to markup.

1. ``body_blocks`` parses WordprocessingML in an Arrow batch function: one struct
   for each child of the body, with what must be read in order (the state of
   contents fields) already folded in.
2. ``front_matter`` classifies the blocks with windows over a document's blocks:
   a block's own marks, the block after it (contents headings), the first section
   (cover lines) and runs between headings (metadata lines).
3. ``marked_documents`` puts paired bookmarks around classified paragraphs of a
   disposable copy and returns the map of markers to roles.

Defined cases: null or malformed XML, or XML without a body, gives no blocks and an
error; ambiguous paragraphs get no role; an empty body has no roles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from xml.dom import Node, minidom
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from prosegauge import fixed
from prosegauge.functions.chars import casefold, in_class

_NS = "{" + fixed.WORD_NAMESPACE + "}"
_CONTENTS_FIELD = re.compile(r"(?i)\s*TOC(?:\s|$)")
_FIELDS = (
    ("position", "int"), ("kind", "string"), ("text", "string"), ("style", "string"), ("outline", "string"),
    ("ends_section", "boolean"), ("gallery", "string"), ("cell_label", "string"),
    ("simple_field", "string"), ("in_field", "boolean"), ("out_of_field", "boolean"),
)
_DDL = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_ARROW = pa.struct([(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in _FIELDS])


def _plain(node: ElementTree.Element) -> str:
    return " ".join("".join(t.text or "" for t in node.iter(_NS + "t")).split())


def _value(node: ElementTree.Element, path: str) -> str | None:
    found = node.find("/".join(_NS + step for step in path.split("/")))
    return None if found is None else found.get(_NS + "val", "")


def _cell_label(block: ElementTree.Element) -> str | None:
    """First text of a table of one cell without a table in it."""
    rows = block.findall(_NS + "tr") if block.tag == _NS + "tbl" else []
    cells = rows[0].findall(_NS + "tc") if len(rows) == 1 else []
    if len(cells) != 1 or cells[0].find(f".//{_NS}tbl") is not None:
        return None
    for p in cells[0].findall(_NS + "p"):
        if any((t.text or "").strip() for t in p.iter(_NS + "t")):
            return _plain(p)
    return None


def _simple_field(paragraph: ElementTree.Element) -> str | None:
    """Whether all text of the paragraph stands in one simple contents field."""
    fields = [f for f in paragraph.findall(_NS + "fldSimple") if _CONTENTS_FIELD.match(f.get(_NS + "instr", ""))]
    if not fields:
        return None
    filled = {t for t in paragraph.iter(_NS + "t") if (t.text or "").strip()}
    return "whole" if any(filled.issubset(set(f.iter(_NS + "t"))) for f in fields) else "part"


class _Fields:
    """State of complex fields across paragraphs: which hold results of a completed
    outermost contents field, and which hold text outside of one."""

    def __init__(self):
        self.inside: set[int] = set()
        self.outside: set[int] = set()
        self.leave()

    def leave(self) -> None:
        self.instructions: list[str] = []
        self.in_result = False
        self.pending: set[int] = set()

    def read(self, position: int, paragraph: ElementTree.Element) -> None:
        for node in paragraph.iter():
            name = node.tag.removeprefix(_NS)
            if name == "fldChar":
                self._turn(node.get(_NS + "fldCharType"))
            elif name == "instrText" and self.instructions:
                self.instructions[-1] += node.text or ""
            elif name == "t" and (node.text or "").strip():
                (self.pending if self.in_result else self.outside).add(position)

    def _turn(self, kind: str | None) -> None:
        if kind == "begin":
            if not self.instructions:
                self.leave()
            self.instructions.append("")
        elif kind == "separate" and len(self.instructions) == 1:
            self.in_result = self.in_result or bool(_CONTENTS_FIELD.match(self.instructions[0]))
        elif kind == "end" and self.instructions:
            self.instructions.pop()
            if not self.instructions and self.in_result:
                self.inside |= self.pending
                self.in_result = False


def body_of(xml: bytes | str) -> ElementTree.Element:
    root = ElementTree.fromstring(xml)
    body = root if root.tag == _NS + "body" else root.find(_NS + "body")
    if body is None:
        raise ValueError("Expected a WordprocessingML body")
    return body


def parse(xml: bytes | str) -> list[dict]:
    """The body's children as rows."""
    fields, rows = _Fields(), []
    for position, block in enumerate(body_of(xml)):
        kind = block.tag.removeprefix(_NS)
        row = dict.fromkeys((n for n, _ in _FIELDS), None) | {"position": position, "kind": kind, "text": _plain(block), "ends_section": False}
        if kind == "p":
            style = _value(block, "pPr/pStyle")
            row["style"] = (style or "").replace(" ", "")
            row["outline"] = _value(block, "pPr/outlineLvl")
            row["ends_section"] = block.find(f"{_NS}pPr/{_NS}sectPr") is not None
            row["simple_field"] = _simple_field(block)
            fields.read(position, block)
        else:
            fields.leave()
            row["cell_label"] = _cell_label(block)
            if kind == "sdt":
                row["gallery"] = _value(block, "sdtPr/docPartObj/docPartGallery")
        rows.append(row)
    for row in rows:
        row["in_field"], row["out_of_field"] = row["position"] in fields.inside, row["position"] in fields.outside
    return rows


def body_blocks(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """``documents`` with ``word_blocks`` and ``word_error``."""
    kept = [c for c in documents.columns if c not in ("word_blocks", "word_error")]
    source = documents.select(*kept)
    at = kept.index(xml)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for content in batch.column(at).to_pylist():
                try:
                    found.append(parse(content) if content is not None else [])
                    errors.append(None if content is not None else "WordprocessingML is missing")
                except (ElementTree.ParseError, ValueError) as wrong:
                    found.append([])
                    errors.append(str(wrong))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(_ARROW)), pa.array(errors, pa.string())], names=[*kept, "word_blocks", "word_error"]
            )

    schema = StructType(list(source.schema.fields)).add("word_blocks", ArrayType(StructType.fromDDL(_DDL))).add("word_error", StringType())
    return source.mapInArrow(run, schema)


def front_matter(documents: DataFrame, *, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """``key``, ``position``, ``role`` and ``basis`` of classified blocks."""
    parsed = body_blocks(documents.select(key, xml), xml)
    rows = parsed.select(F.col(key), F.explode("word_blocks").alias("b")).select(key, "b.*")
    of_doc = Window.partitionBy(key)
    in_order = of_doc.orderBy("position")

    def labelled(role: str, basis: str):
        return F.struct(F.lit(role).alias("role"), F.lit(basis).alias("basis"))

    contents, mixed = "table_of_contents", (F.col("simple_field") == "part") | (F.col("in_field") & F.col("out_of_field"))
    gallery = casefold(F.col("gallery"))
    own = (
        F.when(F.coalesce(mixed, F.lit(False)), None)
        .when(F.col("cell_label").rlike(fixed.INSTRUCTION_LABEL), labelled("instruction", "table"))
        .when(gallery == "cover pages", labelled("cover", "gallery"))
        .when(gallery == "table of contents", labelled(contents, "gallery"))
        .when(F.col("simple_field") == "whole", labelled(contents, "field"))
        .when(F.col("style").rlike("(?i)^toc[1-9]$"), labelled(contents, "style"))
        .when(F.col("in_field") & ~F.col("out_of_field"), labelled(contents, "field"))
    )
    is_p = F.col("kind") == "p"
    heading = is_p & (F.col("style").rlike("(?i)^heading[1-9]$") | F.coalesce(F.col("outline").rlike("^[0-8]$"), F.lit(False)))
    rows = rows.withColumn("own", own).withColumn("mixed", F.coalesce(mixed, F.lit(False))).withColumn("heading", heading)
    beside = (F.lead("own").over(in_order)["role"] == contents) & (F.lower("style") == "tocheading") & is_p & ~F.col("mixed")
    rows = rows.withColumn("own", F.coalesce("own", F.when(beside, labelled(contents, "label"))))

    # the first section, if it is nothing but short lines before a table of contents
    allowed = F.col("kind").isin("p", "bookmarkStart", "bookmarkEnd") & F.col("own").isNull()
    rows = rows.withColumn("end", F.min(F.when(is_p & F.col("ends_section"), F.col("position"))).over(of_doc))
    rows = rows.withColumn("first_other", F.min(F.when(~allowed, F.col("position"))).over(of_doc))
    counts = (F.col("position") > F.col("end")) & (~is_p | (F.col("text") != ""))
    rows = rows.withColumn("after", F.when(counts, F.sum(F.when(counts, 1)).over(in_order)))
    is_contents = F.coalesce(F.col("own")["role"] == contents, F.lit(False))
    first = F.max(F.when(F.col("after") == 1, F.struct(is_contents.alias("c"), is_p.alias("p")))).over(of_doc)
    second = F.coalesce(F.max(F.when(F.col("after") == 2, is_contents)).over(of_doc), F.lit(False))
    rows = rows.withColumn("leads", F.coalesce(first["c"] | (first["p"] & second), F.lit(False)))
    in_section = is_p & (F.col("position") <= F.col("end"))
    line = in_section & (F.col("text") != "")
    words = F.size(F.split("text", " "))
    prose = F.col("text").rlike(rf"[.!?][{in_class(fixed.SENTENCE_CLOSERS + ']')}]*$")
    fits = (
        F.col("leads")
        & (F.coalesce(F.col("first_other"), F.lit(1 << 30)) > F.col("end"))
        & (F.sum(F.when(line, words).otherwise(0)).over(of_doc) <= fixed.COVER_MAX_WORDS)
        & (F.max(F.when(line, words).otherwise(0)).over(of_doc) <= fixed.COVER_MAX_PARAGRAPH_WORDS)
        & ~F.max(in_section & F.col("heading")).over(of_doc)
        & ~F.max(line & prose).over(of_doc)
    )
    rows = rows.withColumn("own", F.when(line & fits, labelled("cover_position", "section")).otherwise(F.col("own")))

    # runs of paragraphs below a heading; the first that looks generated counts
    opens = ~is_p | F.col("heading")
    rows = rows.withColumn("low", casefold(F.col("text"))).withColumn("run", F.sum(opens.cast("int")).over(in_order))
    of_run = Window.partitionBy(key, "run")
    titled = F.max(F.col("heading") & F.col("low").isin(*fixed.METADATA_HEADINGS)).over(of_run)
    nth = F.row_number().over(of_run.orderBy("position"))
    rows = rows.withColumn("nth", nth).withColumn("titled", titled)
    starts = F.max((F.col("nth") == 2) & F.col("low").startswith("opdiv:")).over(of_run)
    numbered = F.max((F.col("nth") >= 2) & F.col("low").startswith("opportunity number:")).over(of_run)
    rows = rows.withColumn("generated", F.col("titled") & starts & numbered)
    chosen = F.min(F.when(F.col("generated"), F.col("run"))).over(of_doc)
    is_metadata = (F.col("run") == chosen) & (F.col("nth") >= 2) & F.col("text").rlike(rf"(?i)^metadata (?:author|subject|keywords):[{fixed.WS}]*[^{fixed.WS}]")
    role = F.coalesce(F.col("own"), F.when(is_metadata, labelled("metadata", "builder")))
    return rows.select(key, "position", role.alias("found")).where("found is not null").select(key, "position", "found.role", "found.basis")


def mark(xml: bytes | str, roles: dict[int, str], *, source_sha256: str, instruction_paragraphs: tuple[int, ...] = ()) -> tuple[str, dict[str, str]]:
    """The XML with paired bookmarks around paragraphs of classified blocks, and the
    role of each marker.

    Works on the document as written: prefixes and declarations stay.  Marker names
    depend on the source alone and collide with no bookmark there is; new ids
    neither.  Paragraphs that hold further paragraphs are not marked.
    """
    document = minidom.parseString(xml)
    named = lambda node, name: node.getElementsByTagNameNS(fixed.WORD_NAMESPACE, name)
    bodies = [document.documentElement] if document.documentElement.localName == "body" else named(document, "body")
    if len(bodies) != 1:
        return document.toxml(), {}
    attr = lambda node, name: node.getAttributeNS(fixed.WORD_NAMESPACE, name)
    starts = named(bodies[0], "bookmarkStart")
    names = {attr(n, "name") for n in starts}
    taken = {attr(n, "id") for n in [*starts, *named(bodies[0], "bookmarkEnd")]}
    salt = 0
    while True:
        prefix = "scope_" + hashlib.sha256(f"{source_sha256}:{salt}".encode()).hexdigest()[:16]
        if not any(n.startswith(prefix + "_") for n in names):
            break
        salt += 1
    children = [n for n in bodies[0].childNodes if n.nodeType == Node.ELEMENT_NODE]
    role_of: dict = {}
    for position in sorted(roles):
        block = children[position]
        own = [block] if block.localName == "p" and block.namespaceURI == fixed.WORD_NAMESPACE else []
        for p in own + list(named(block, "p")):
            role_of[p] = roles[position]
    paragraphs = named(bodies[0], "p")
    for k in instruction_paragraphs:
        role_of[paragraphs[k]] = "instruction"
    free = (str(k) for k in range(1 << 31) if str(k) not in taken)
    markers: dict[str, str] = {}
    for paragraph, role in role_of.items():
        if named(paragraph, "p"):
            continue
        key = f"{prefix}_{len(markers)}"
        elements = [n for n in paragraph.childNodes if n.nodeType == Node.ELEMENT_NODE]
        head = elements[0] if elements and elements[0].localName == "pPr" else None
        before = head.nextSibling if head is not None else paragraph.firstChild
        for name, place in ((key + "_s", before), (key + "_e", None)):
            own_prefix = paragraph.prefix
            tag = f"{own_prefix}:" if own_prefix else ""
            pair = [document.createElementNS(fixed.WORD_NAMESPACE, tag + kind) for kind in ("bookmarkStart", "bookmarkEnd")]
            number = next(free)
            for node in pair:
                if not own_prefix:
                    node.setAttribute("xmlns:scopeWord", fixed.WORD_NAMESPACE)
                node.setAttributeNS(fixed.WORD_NAMESPACE, f"{own_prefix or 'scopeWord'}:id", number)
                paragraph.insertBefore(node, place)
            pair[0].setAttributeNS(fixed.WORD_NAMESPACE, f"{own_prefix or 'scopeWord'}:name", name)
        markers[key] = role
    return document.toxml(), markers


def marked_documents(documents: DataFrame, *, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """``documents`` with ``marked_xml`` and ``word_boundaries`` (marker to role)."""
    found = front_matter(documents, key=key, xml=xml).groupBy(F.col(key).alias("_key")).agg(
        F.map_from_entries(F.collect_list(F.struct("position", "role"))).alias("_roles")
    )
    joined = documents.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    kept = [c for c in joined.columns if c not in ("marked_xml", "word_boundaries")]
    at, roles_at = kept.index(xml), kept.index("_roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, maps = [], []
            for content, roles in zip(batch.column(at).to_pylist(), batch.column(roles_at).to_pylist()):
                text, markers = None, {}
                if content is not None:
                    raw = content.encode() if isinstance(content, str) else content
                    try:
                        text, markers = mark(content, dict(roles or ()), source_sha256=hashlib.sha256(raw).hexdigest())
                    except (ExpatError, ValueError):
                        pass  # malformed: a row without marks
                out.append(text)
                maps.append(list(markers.items()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string()), pa.array(maps, pa.map_(pa.string(), pa.string()))],
                names=[*kept, "marked_xml", "word_boundaries"],
            )

    source = joined.select(*kept)
    schema = StructType(list(source.schema.fields)).add("marked_xml", StringType()).add("word_boundaries", MapType(StringType(), StringType()))
    return source.mapInArrow(run, schema).drop("_roles")
