"""Flat and tagged pages, reflow, reliability and estimates."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.operators import pages, reflow, tagged
from prosegauge.operators.reliability import reliability
from prosegauge.plans import contracts, registry
from prosegauge.plans.analyze import analysis_results, analyze, measure_documents
from prosegauge.plans.result_schema import check_results
from prosegauge.plans.registry import FLAT_PDF, TAGGED_PDF, flat_documents, tagged_documents
from prosegauge.schema import PDF_ANNOTS, PDF_LINES, PDF_PAGES, PDF_SHAPES, PDF_TAGS, PDF_WORDS
from prosegauge.sources import pdf
from prosegauge.sources.files import SourceBundle, bundle_frame
from prosegauge.sources.pdf import align_geometry, aligned
from prosegauge.sources.profiles import load_profile

FOLDER = "/root/testdata/sf0.001"


def lines_frame(spark, book, doc=0):
    rows = [(doc, p, k, t, None) for p, page in enumerate(book, 1) for k, t in enumerate(page)]
    return pages.clean_lines(spark.createDataFrame(rows, PDF_LINES))


BOOK = [["Report 1", "Some text on page one.", "Page 1 of 4"], ["Report 2", "More  text.", "Page 2 of 4"], ["Report 3", "", "Yet more.", "Page 3 of 4"], ["Odd start", "End."]]


def test_repeated_edges(spark):
    lines = lines_frame(spark, BOOK)
    got = {r["pattern"]: r["pages"] for r in pages.repeated_edges(lines, edge_lines=1).collect()}
    assert got == {"report #": 3, "page # of #": 3}
    assert pages.repeated_edges(lines, edge_lines=1, min_pages=4).count() == 0
    many = spark.createDataFrame([(0, 11)], "doc_id long, page_count long")
    assert pages.repeated_edges(lines, many, edge_lines=1).count() == 0  # 30 % of 11 pages are 4


def test_line_segments(spark):
    got = pages.line_segments(lines_frame(spark, BOOK)).orderBy("reading_order").collect()
    assert [(r["segment_id"], r["role"]) for r in got][:5] == [
        ("p0001-l0001", "header"), ("p0001-l0002", "cover"), ("p0001-l0003", "footer"), ("p0002-l0001", "header"), ("p0002-l0002", "body"),
    ]
    assert [r["boundary_before"] for r in got][:4] == ["page", "line", "line", "page"] and got[4]["text"] == "More text."
    assert got[-2]["role"] == "body" and got[-1]["role_basis"] == "pdf-line-default@1.0.0"


def box(left, top):
    return {"left": float(left), "top": float(top), "right": 500.0, "bottom": float(top + 12)}


def segs(spark, rows):
    made = [(0, k, t, p, b, r, "low", "x") for k, (t, p, b, r) in enumerate(rows)]
    kind = "doc_id long, reading_order int, text string, page int, bbox struct<left:double,top:double,right:double,bottom:double>, role string, role_confidence string, role_basis string"
    return spark.createDataFrame(made, kind)


def test_reflow(spark):
    rows = [
        ("Starts here", 1, box(72, 72), "body"),
        ("goes on.", 1, box(72, 86), "body"),
        ("After a gap", 1, box(72, 130), "body"),
        ("shifted", 1, box(90, 144), "body"),
        ("• item", 1, box(72, 158), "list"),
        ("of item", 1, box(90, 172), "body"),
        ("no box", 1, None, "body"),
        ("HEAD", 1, box(72, 300), "heading"),
        ("below", 1, box(72, 314), "body"),
        ("above", 1, box(72, 200), "body"),
        ("next page", 2, box(72, 72), "body"),
    ]
    got = reflow.with_reasons(segs(spark, rows)).orderBy("reading_order").collect()
    assert [r["reason"] for r in got] == [
        "document_start", "continuation", "vertical_gap", "horizontal_shift", "list_item", "continuation", "missing_geometry", "structural_role",
        "structural_role", "overlapping_or_reordered_lines", "page",
    ]
    blocks = reflow.reflow(segs(spark, rows)).orderBy("reading_order").collect()
    assert blocks[0]["text"] == "Starts here goes on." and blocks[0]["bbox"]["bottom"] == 98.0 and blocks[0]["segment_id"] == "flat-pdf-block-00001"
    item = next(b for b in blocks if b["role"] == "list")
    assert (item["text"], item["role_confidence"], item["role_basis"]) == ("• item of item", "low", reflow.METHOD)
    facts = reflow.reflow_diagnostics(segs(spark, rows)).first()
    assert (facts["paragraph_count"], facts["geometry_line_count"], facts["geometry_coverage"]) == (9, 10, round(10 / 11, 6))
    assert facts["decision_counts"]["structural_role"] == 2


def test_flat_estimate(spark):
    book = [["Report 1", "The plan is reviewed by staff.", "It runs"], ["on here."], []]
    rows = [(0, p, k, t, (72.0, 72.0 + 14 * k, 500.0, 84.0 + 14 * k)) for p, page in enumerate(book, 1) for k, t in enumerate(page)]
    sources = bundle_frame(spark, [SourceBundle.from_pdf(b"%PDF-1.7")])
    facts = spark.createDataFrame([(0, p, 612.0, 792.0, p == 3) for p in (1, 2, 3)], PDF_PAGES)
    docs = flat_documents(sources, spark.createDataFrame(rows, PDF_LINES), facts).withColumn("support", F.lit(None).cast("struct<status:string,evidence:array<struct<code:string,value:string,confidence:string>>,reason:string>"))
    assert contracts.violations(docs).count() == 0
    profile = load_profile("generic-pdf-estimate@0.6.0")
    result = analysis_results(measure_documents(docs, profile, estimate="flat_pdf"), profile, adapter=FLAT_PDF, estimate="flat_pdf")
    assert contracts.result_violations(result).collect() == []
    r = result.first().asDict(True)
    words = r["metrics"]["word_count"]
    assert words["status"] == "estimated" and words["reliability"]["level"] == "low"
    assert words["reliability"]["reason_codes"][-1] == "flat_pdf_semantic_structure_unavailable" and "page_extraction_incomplete" in words["reliability"]["reason_codes"]
    assert r["coverage"]["extraction_error_pages"] == [3] and r["coverage"]["pages_with_text"] == 2
    assert [w["code"] for w in r["warnings"]][-2:] == ["flat_pdf_estimate_reliability_attached", "adapter_warning"]
    assert "from 4 line(s), with 100.0% line-geometry" in r["warnings"][-2]["message"]


@pytest.mark.parametrize(
    "metric,a,b,unknown,failed,level",
    [
        ("word_count", 1000.0, 995.0, 0, 0, "high"),
        ("word_count", 1000.0, 990.0, 0, 0, "moderate"),
        ("word_count", 1000.0, 950.0, 0, 0, "low"),
        ("word_count", 1000.0, 1000.0, 6, 0, "moderate"),
        ("word_count", 1000.0, 1000.0, 21, 0, "low"),
        ("word_count", 1000.0, 1000.0, 0, 1, "low"),
        ("word_count", 1000.0, None, 0, 0, "low"),
        ("flesch_kincaid_grade_level", 8.0, 8.3, 0, 0, "moderate"),
        ("flesch_kincaid_grade_level", 8.0, 8.2, 0, 0, "high"),
        ("passive_sentence_percentage", 10.0, 10.8, 0, 0, "moderate"),
        ("flesch_reading_ease", 60.0, 64.0, 0, 0, "low"),
    ],
)
def test_reliability(spark, metric, a, b, unknown, failed, level):
    row = spark.createDataFrame([(a, b, unknown, failed)], "a double, b double, u long, f int").select(
        reliability(metric, included=F.col("a"), excluded=F.col("b"), classification_coverage=F.lit(1.0), unknown_segments=F.col("u"), unknown_words=F.col("u"), total_words=F.lit(1000), failed_pages=F.col("f")).alias("r")
    ).first()["r"]
    assert row["level"] == level and len(set(row["reason_codes"])) == len(row["reason_codes"]) > 0
    if b is not None:
        assert row["sensitivity"]["absolute_delta"] == round(abs(a - b), 4)
        assert row["sensitivity"]["relative_delta_percent"] == round(abs(a - b) / max(abs(a), abs(b), 1.0) * 100, 4)


def test_alignment(spark):
    assert aligned(["a", "b", "c"], ["x", "b", "c"]) == [None, 1, 2]
    lines = spark.createDataFrame([(0, 1, 0, "a"), (0, 1, 1, "b"), (0, 2, 0, "z")], "doc_id long, page int, line_index int, text string")
    seen = spark.createDataFrame([(0, 1, 0, "b", (1.0, 2.0, 3.0, 4.0))], "doc_id long, page int, k int, text string, bbox struct<left:double,top:double,right:double,bottom:double>")
    got = {(r["page"], r["line_index"]): r["bbox"] for r in align_geometry(lines, seen).collect()}
    assert got[1, 0] is None and got[1, 1]["left"] == 1.0 and got[2, 0] is None


# ---- tagged pages --------------------------------------------------------------


class Doc:
    """Words, tags, shapes and annotations of an invented document."""

    def __init__(self):
        self.words, self.tags, self.shapes, self.annots, self.pages = [], [], [], [], set()

    def put(self, page, text, top=100.0, left=50.0, group=None, tag=None, path=(), cell=None, leaf=None):
        """Words of one marked item on one line, 30 points apart."""
        self.pages.add(page)
        mcid = len(self.tags) + 1000 * len(self.words)
        if group:
            self.tags.append((0, page, mcid, len(self.tags), [*path, tag], group, tag, cell))
        top, left = float(top), float(left)
        for k, t in enumerate(text.split()):
            n = sum(w[1] == page for w in self.words)
            at = left + 30 * k
            self.words.append((0, page, n, t, at, top, at + 20, top + 10, None, None, mcid if group else None, leaf))

    def tables(self, spark):
        size = [(0, p, 600.0, 800.0, False) for p in sorted(self.pages)]
        return [
            spark.createDataFrame(r, k)
            for r, k in ((self.words, PDF_WORDS), (self.tags, PDF_TAGS), (self.shapes, PDF_SHAPES), (self.annots, PDF_ANNOTS), (size, PDF_PAGES))
        ]

    def segments(self, spark):
        return tagged.tagged_segments(*self.tables(spark)).orderBy("reading_order").collect()


def test_roles_of_groups(spark):
    d = Doc()
    d.put(1, "Plain body text.", 100, group="a", tag="P")
    d.put(1, "A heading", 120, group="b", tag="H2")
    d.put(1, "In a cell", 140, group="c", tag="P", path=("Table", "TD"), cell="t")
    d.put(1, "1.", 160, group="d", tag="Lbl", path=("L", "LI"))
    d.put(1, "Note", 170, group="e", tag="Lbl", path=("L", "LI"))
    d.put(1, "Cover name", 180, group="f", tag="P", path=("AgencyCover",))
    d.put(1, "Entry", 200, group="g", tag="H1", path=("TOC",))
    d.put(1, "stray words", 220)
    d.put(1, "art", 240, leaf="/Artifact")
    got = d.segments(spark)
    assert [(r["segment_id"], r["text"], r["role"]) for r in got] == [
        ("p0001-g0001", "Plain body text.", "body"), ("p0001-g0002", "A heading", "heading"), ("p0001-g0003", "In a cell", "table"),
        ("p0001-g0004", "1.", "decorative"), ("p0001-g0005", "Note", "heading"), ("p0001-g0006", "Cover name", "cover"),
        ("p0001-g0007", "Entry", "table_of_contents"), ("p0001-u0001", "stray words", "unknown"), ("p0001-u0002", "art", "decorative"),
    ]
    assert got[3]["role_basis"].endswith(":Lbl:source-declared-numeric-list-label") and got[5]["role_basis"].endswith(":source-declared-container")
    assert got[7]["warnings"] == ["untagged_content_order_unresolved"] and [r["boundary_before"] for r in got][:2] == ["page", "paragraph"]


def test_words_keep_marked_order_and_lines(spark):
    d = Doc()
    d.put(1, "second", 100, group="a", tag="P")
    d.put(1, "first", 300, group="a", tag="P")
    d.words.append((0, 1, 5, "bold", 10.0, 98.5, 20.0, 110.0, None, None, d.words[0][10], None))
    assert [r["text"] for r in d.segments(spark)] == ["bold second first"]


def test_line_fold_looks_back_four_lines():
    assert tagged.fold_lines([(10.0, 5.0, 0), (12.0, 1.0, 1), (40.0, 0.0, 2), (11.0, 9.0, 3)]) == [0, 0, 1, 0]
    assert tagged.fold_lines([(0.0, 0.0, 0), (3.0, 0.0, 1), (4.6, 0.0, 2), (6.0, 0.0, 3)]) == [0, 0, 1, 1]


def test_void_tags(spark):
    tags = spark.createDataFrame([(0, 1, 1, 0, ["P"], "a", "P", None), (0, 1, 1, 5, ["P"], "b", "P", None), (0, 1, 2, 1, ["P"], "a", "P", None), (0, 1, 2, 1, ["P"], "a", "P", None)], PDF_TAGS)
    assert [(r["mcid"], r["group_id"]) for r in tagged.sound_tags(tags).collect()] == [(2, "a")]


def test_panels(spark):
    d = Doc()
    d.put(1, "a b c", 100, 400.0, group="g", tag="P")
    d.put(1, "in", 130, 500.0, group="h", tag="P")
    d.shapes = [(0, 1, 440.0, 50.0, 600.0, 400.0, True), (0, 1, 450.0, 60.0, 600.0, 300.0, True), (0, 1, 440.0, 50.0, 600.0, 70.0, True), (0, 1, 440.0, 500.0, 600.0, 700.0, False), (0, 1, 100.0, 0.0, 600.0, 700.0, True)]
    _, _, shapes, _, size = d.tables(spark)
    assert [len(r["panels"]) for r in tagged.panels(shapes, size).collect()] == [1]
    got = d.segments(spark)
    assert got[0]["role"] == "unknown" and got[0]["warnings"] == ["structure_group_crosses_panel_boundary", "unsupported_structure_group_tag"]
    assert got[1]["role"] == "body" and got[1]["role_basis"].endswith(":P:right-bleed-panel")


def test_repeated_navigation(spark):
    d = Doc()
    for page in (1, 2, 3):
        if page == 1:
            d.put(page, "Go home", 10, group="n", tag="LBody")
        else:
            d.put(page, "Go home", 11, 51.0, leaf="Artifact")
    d.put(2, "Other top", 30, group="m", tag="P")
    d.put(3, "Go", 20, group="o", tag="P")
    got = {r["text"]: r["role"] for r in d.segments(spark) if r["kind"] == "group"}
    assert got == {"Go home": "navigation", "Other top": "body", "Go": "body"}


def test_links(spark):
    d = Doc()
    d.put(1, "Read more", 100)
    d.put(1, "Not this", 130)
    d.annots = [(0, 1, "/Link", "Read  more", 49.5, 100.0, 101.0, 110.0), (0, 1, "/Link", "Not this", 60.0, 130.0, 120.0, 140.0), (0, 1, "/Text", "Not this", 0.0, 0.0, 600.0, 800.0)]
    assert [(r["text"], r["role"]) for r in d.segments(spark)] == [("Read more", "navigation"), ("Not this", "unknown")]


def test_pages_are_joined(spark):
    d = Doc()
    d.put(1, "A paragraph that", 700, group="a", tag="P")
    d.put(1, "Foot", 750, group="f", tag="P")
    d.put(2, "goes on.", 50, group="a", tag="P")
    d.put(2, "Head", 70, group="h", tag="H1")
    d.put(3, "Head", 50, group="h", tag="H1")
    d.put(3, "cell", 80, group="t", tag="TD", cell="t")
    d.put(3, "inner", 90, group="i", tag="P", path=("TD",), cell="t")
    d.put(4, "rest", 50, group="t", tag="TD", cell="t")
    got = d.segments(spark)
    assert [r["text"] for r in got] == ["A paragraph that goes on.", "Foot", "Head", "Head", "cell", "inner", "rest"]
    assert got[0]["bbox"] is None and got[0]["role_basis"].endswith(":P:cross-page-paragraph") and got[0]["pages"] == [1, 2]


def test_structure_walk(spark):
    tree = {"S": "/Document", "K": [
        {"S": "/P", "Pg": 1, "K": [0, {"S": "/Span", "MCID": 1}]},
        {"S": "/L", "K": [{"S": "/LI", "K": [{"S": "/Lbl", "Pg": 1, "K": 2}, {"S": "/LBody", "Pg": 1, "K": [{"S": "/P", "K": 3}, {"S": "/Lbl", "K": 7}]}]}]},
        {"S": "/TD", "Pg": 2, "K": [0, {"S": "/P", "K": 1}]},
        {"S": "/Sect", "Pg": 2, "K": 9},
    ]}
    got = tagged.walk_structure(tree)
    assert [(t["page"], t["mcid"], t["rank"], t["group_tag"], t["cell_id"]) for t in got] == [
        (1, 0, 0, "P", None), (1, 1, 1, "P", None), (1, 2, 2, "Lbl", None), (1, 3, 3, "LBody", None), (1, 7, 4, "Lbl", None),
        (2, 0, 5, "TD", "structure-group-4"), (2, 1, 6, "P", "structure-group-4"),
    ]
    assert got[1]["tag_path"] == ["Document", "P", "Span"] and got[0]["group_id"] == got[1]["group_id"] != got[2]["group_id"]
    rows = tagged.structure_tags(spark.createDataFrame([(7, json.dumps(tree)), (8, None)], "doc_id long, tree string")).collect()
    assert len(rows) == 7 and {r["doc_id"] for r in rows} == {7}


def test_tagged_estimate(spark):
    d = Doc()
    d.put(1, "Applications are reviewed by staff.", 100, group="a", tag="P")
    d.put(1, "Submit complete forms.", 120, group="b", tag="LBody")
    d.put(2, "loose words here", 100)
    words, tags, shapes, annots, size = d.tables(spark)
    sources = bundle_frame(spark, [SourceBundle.from_pdf(b"%PDF-1.7")]).withColumn("support", F.lit(None).cast("struct<status:string,evidence:array<struct<code:string,value:string,confidence:string>>,reason:string>"))
    docs = tagged_documents(sources, words=words, tags=tags, shapes=shapes, annots=annots, pages=size)
    assert contracts.violations(docs).count() == 0
    profile = load_profile("pdf-estimate@0.7.0")
    result = analysis_results(measure_documents(docs, profile, estimate="tagged_pdf"), profile, adapter=TAGGED_PDF, estimate="tagged_pdf")
    assert contracts.result_violations(result).collect() == []
    check_results(result, "1.2.0")
    r = result.first().asDict(True)
    assert r["metrics"]["word_count"]["value"] == 11 and r["metrics"]["word_count"]["reliability"]["sensitivity"]["excluded_unknown_value"] == 8
    assert r["metrics"]["passive_sentence_percentage"]["value"] == 50.0 and r["metrics"]["words_per_sentence"]["value"] == 4.0
    assert r["adapter"]["extraction_coverage"]["status"] == "partial" and r["coverage"]["unknown_role_count"] == 1
    assert r["metrics"]["word_count"]["reliability"]["level"] == "low" and r["schema_version"] == "1.2.0"


def test_strict_profiles_refuse_unknown_roles(spark):
    d = Doc()
    d.put(1, "Some text here.", 100)
    words, tags, shapes, annots, size = d.tables(spark)
    docs = tagged_documents(bundle_frame(spark, [SourceBundle.from_pdf(b"%PDF-")]), words=words, tags=tags, shapes=shapes, annots=annots, pages=size)
    profile = load_profile("semantic-html@0.6.0")
    r = analysis_results(measure_documents(docs, profile), profile).first()
    assert {m: r["metrics"][m]["reason"] for m in fixed.METRICS} == dict.fromkeys(fixed.METRICS, fixed.UNKNOWN_ROLE_REASON)
    assert random.choice(fixed.METRICS) and r["metrics"]["word_count"]["status"] == "unable_to_calculate"


# ---- files ---------------------------------------------------------------------


def test_a_broken_file_ends_nothing(spark, monkeypatch):
    """Broken, missing and refused files have an error each; the others are read, once."""
    read = spark.sparkContext.accumulator(0)

    def stub(content):
        read.add(1)
        if b"broken" in content:
            raise RuntimeError("/secret/path")
        lines = content.decode().split("\n")[1:]
        box = {"left": 72.0, "right": 500.0}
        return {
            "lines": [{"page": 1, "line_index": k, "text": t} for k, t in enumerate(lines)],
            "geometry": [{"page": 1, "k": k, "text": t, "bbox": box | {"top": 72.0 + 14 * k, "bottom": 84.0 + 14 * k}} for k, t in enumerate(lines)],
            "words": [{"page": 1, "native_index": k, "text": t, "left": 50.0 + 40 * k, "top": 100.0, "right": 80.0 + 40 * k, "bottom": 110.0, "mcid": 1} for k, t in enumerate(lines[0].split())],
            "pages": [{"page": 1, "width": 600.0, "height": 800.0, "extraction_failed": False}],
            "tree": json.dumps({"S": "P", "Pg": 1, "K": 1}),
            "metadata": [("Producer", "stub")],
        }

    contents = [b"%PDF-1.7\nForms are reviewed.", b"%PDF- broken", b"no header", b"%PDF-1.4\nMore text here. It goes on."]
    sources = bundle_frame(spark, [SourceBundle.from_pdf(c) for c in contents])
    gone = sources.where("doc_id = 0").withColumns({"doc_id": F.lit(9).cast("long"), "content": F.lit(None).cast("binary")})
    unnamed = sources.where("doc_id = 0").withColumns({"doc_id": F.lit(8).cast("long"), "revision": F.lit(" ")})
    monkeypatch.setattr(pdf, "need_libraries", lambda: None)
    monkeypatch.setattr(registry.pdf, "read_pages", lambda files: pdf_read(files, stub))
    for profile in ("generic-pdf-estimate@0.6.0", "pdf-estimate@0.7.0"):
        read.value = 0
        rows = {r["doc_id"]: r for r in analyze(sources.unionByName(gone).unionByName(unnamed), profile).collect()}
        assert {k: r["error"] and r["error"]["code"] for k, r in rows.items()} == {
            0: None, 1: "adapter_execution_error", 2: "adapter_contract_error", 3: None, 8: "input_error", 9: "adapter_contract_error",
        }
        assert read.value == 3 and "secret" not in str(rows) and "header" in rows[2]["error"]["message"] and "revision" in rows[8]["error"]["message"]
        assert rows[0]["coverage"]["segments_total"] == 1 and rows[0]["source"]["observed_pdf_metadata"] == {"Producer": "stub"}
        assert rows[0]["metrics"]["word_count"]["value"] == (3.0 if profile.startswith("pdf") else 0.0)  # a flat page begins with a cover
    assert pdf_read(gone, stub).first()["error"]["code"] == "input_error"


pdf_read = pdf.read_pages


def test_pdf_header(spark):
    rows = [(0, b"junk %PDF-1.4"), (1, b"\x02\x55\x04\x44\x62\xd0"), (2, b""), (3, None), (4, b"x" * 1030 + b"%PDF-")]
    got = spark.createDataFrame(rows, "id int, content binary").select("id", pdf.has_pdf_header(F.col("content")).alias("has")).collect()
    assert {r["id"]: bool(r["has"]) for r in got} == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_pages_of_documents_are_not_exchanged_word_by_word(spark):
    """Pages made where a document lies give the segments that tables of words give,
    and only groups and lines are exchanged."""
    from prosegauge.plans import queries

    if not os.path.isdir(FOLDER):
        pytest.skip("no data")
    few = queries.table(spark, FOLDER, "documents").where("doc_id % 10 = 3").select("doc_id")
    columns = ["doc_id", "segment_id", "text", "role", "role_basis", "warnings", "in_panel", "pages"]
    of = lambda segments: sorted(map(repr, segments.join(few, "doc_id").select(*columns).collect()))
    made = tagged.page_segments(queries._paged(spark, FOLDER))
    assert of(made) == of(tagged.tagged_segments(*queries._word_tables(spark, FOLDER))) != []
    plan = tagged.page_facts(queries._paged(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_lines_of_many_items_are_those_of_each():
    rng = random.Random(5)
    rows = sorted((k, rng.choice([10.0, 11.5, 13.0, 14.9, 20.0, 24.0]), rng.random(), n) for n, k in enumerate(rng.choices(range(40), k=400)))
    got = tagged.item_lines(*map(np.array, zip(*rows))).tolist()
    want = [x for k in range(40) for x in tagged.fold_lines([r[1:] for r in rows if r[0] == k])]
    assert got == want and len(set(want)) > 2


def test_null_ranks_and_void_tags_of_a_page(spark):
    d = Doc()
    d.put(1, "one two", 100, group="a", tag="P")
    d.put(1, "three", 120, group="b", tag="P")
    d.put(1, "four", 140, group="c", tag="P")
    d.tags.append((*d.tags[2][:3], 9, ["P"], "z", "P", None))  # the third item again, otherwise
    d.tags.append(d.tags[0])  # and the first one, the same
    d.tags[1] = (*d.tags[1][:3], None, *d.tags[1][4:])
    got = d.segments(spark)
    assert [(r["kind"], r["text"]) for r in got] == [("group", "three"), ("group", "one two"), ("line", "four")]


def test_blocks_tell_what_their_lines_were(spark):
    """Blocks and diagnostics are of one pass over the lines."""
    rows = [("One", 1, box(72, 72), "body"), ("more", 1, box(72, 86), "body"), ("no box", 1, None, "body"), ("• item", 1, box(72, 158), "list"), ("next", 2, box(72, 72), "body")]
    lines = segs(spark, rows)
    got = reflow.joined_blocks(lines).groupBy("doc_id").agg(reflow.reflow_facts().alias("r")).select("doc_id", "r.*").first()
    assert got == reflow.reflow_diagnostics(lines).first() and got["decision_counts"]["continuation"] == 1


def test_keys_are_made_of_edges_only(spark):
    """Lines inside a page take no part in the search of repeated edges, and one hot source is no hot key."""
    book = [["Report 1", f"Line {k} stays.", "Report 1", "Page 1 of 4"] for k in range(4)]
    got = pages.classified_lines(lines_frame(spark, book))
    roles = [r["found"]["role"] for r in got.orderBy("page", "line_index").collect()]
    assert roles[::4] == ["header"] * 4 and roles[3::4] == ["footer"] * 4 and not {"header", "footer"} & {*roles[1::4], *roles[2::4]}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "\0" in plan, "lines inside a page are spread by their page"
