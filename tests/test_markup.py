"""Tolerant markup and word-processor front matter."""

import hashlib

import pytest
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.plans.analyze import analyze, analyze_one, inspect_support
from prosegauge.sources import html, markup, word
from prosegauge.sources.files import SourceBundle, bundle_frame

PAGE = """<html><body><nav><a>Skip</a></nav><div id="main"><h1>Title</h1><p>First one here. Second <b>one</b>.</p>
<ul><li>Item one.<li>Item two</ul><table><tr><th>Head<td>Cell text.</table><p hidden>No</p><h7>Seven</h7></div></body></html>"""


def test_roots_roles_and_implied_ends():
    assert markup.blocks(PAGE, "main") == [
        ("Title", "heading", "h1"),
        ("First one here. Second one.", "body", "p"),
        ("Item one.", "list", "li"),
        ("Item two", "list", "li"),
        ("Head", "heading", "th"),
        ("Cell text.", "table", "td"),
        ("Seven", "heading", "h7"),
    ]
    # html and body are no blocks: the whole page is one
    assert [b[1:] for b in markup.blocks(PAGE)] == [("body", "document")]
    with pytest.raises(markup.RootNotFound):
        markup.blocks(PAGE, "other")


@pytest.mark.parametrize(
    "text,blocks",
    [
        ("<blockquote><p>A.</p><p>B.</p></blockquote>", [("A.B.", "body", "blockquote")]),
        ("<p>a<p>b", [("a", "body", "p"), ("b", "body", "p")]),
        ("<div>x <span>y<div>z</div></span><p>q</p>r</div>", [("x yz", "body", "div"), ("q", "body", "p"), ("r", "body", "div")]),
        ("<nav><h2>N</h2><ul><li>i</ul></nav>", [("N", "navigation", "h2"), ("i", "navigation", "li")]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("a", "list", "li"), ("b", "list", "li"), ("c", "list", "li")]),
        ("<li><table><td>t</td></table></li>", [("t", "table", "td")]),
        ("<td><ul><li>l</ul></td>", [("l", "list", "li")]),
        ("<p>a<br>b&nbsp;&amp;c<img alt=x></p>", [("a b &c", "body", "p")]),
        ("<div>t<script>var t='</p>'</script><style>p{}</style></div>", [("t", "body", "div")]),
        ("<div style='Display: none'>n</div><div aria-hidden=TRUE>n</div><p>y", [("y", "body", "p")]),
        ("<dl><dt>T<dd>D<dt>U</dl>", [("T", "heading", "dt"), ("D", "body", "dd"), ("U", "heading", "dt")]),
        ("<div>a<hr>b</div></div></p>", [("a", "body", "div"), ("b", "body", "div")]),
        ("<header><p>h</p></header><footer>f<p>g</footer>", [("h", "header", "p"), ("f", "footer", "footer"), ("g", "footer", "p")]),
        ("<select><option>a<option>b</select>", [("ab", "body", "document")]),
        ("<p/><div/>x", [("x", "body", "document")]),
        ("", []),
    ],
)
def test_blocks(text, blocks):
    assert markup.blocks(text) == blocks


@pytest.mark.parametrize(
    "page,plain",
    [
        ("<!DOCTYPE html><p class=a>a &amp; b<i> </i>c&#32;&lt;p&gt;<!-- <p> --><br/>d</P>", True),
        ("<p title='a\"b' hidden>x</p ><div id=\"&amp;\">&notit;&am<!-- -->p;&#0;&</div>", True),
        ("a&#", True),
        ("<!--><p>--><p>b", True),
        ("<p>a<!-- open <p>b", False),
        ("<p>1 < 2<p>b", False),
        ("<p t='<!-- x -->'>a", False),
        ("<p title='a>b'>c", False),
        ("<script>'<p>'</script><p>a", False),
        ("<p =a>b</><?pi?></1>c", False),
        ("<a href=x/>b<td a= b>c", False),
        ("<p a\x00>b<p\x0bc>d", False),
    ],
)
def test_pages_of_plain_tags_have_the_parser_s_events(page, plain):
    assert markup.events(page) == markup.parsed_events(page)
    assert (markup._plain_events(page) is not None) == plain


def test_each_distinct_tag_is_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(markup, "parsed_events", lambda html, f=markup.parsed_events: parsed.append(html) or f(html))
    page = "<div id=once-1>" + "<p class=once-2>a <i>b</i>" * 5000 + "</div>"
    assert len(markup.blocks(page, "once-1")) == 5000
    assert len(parsed) == len(set(parsed)) <= 4
    tags = "".join(f"<p id=many-{k}>" for k in range(markup.MOST_KNOWN + 10)) + f"<p id={'x' * markup.LONGEST_KNOWN}>"
    assert markup.events(tags) == [("start", "p", {"id": f"many-{k}"}) for k in range(markup.MOST_KNOWN + 10)] + [("start", "p", {"id": "x" * markup.LONGEST_KNOWN})]
    assert len(markup._tags) <= markup.MOST_KNOWN and max(map(len, markup._tags)) <= markup.LONGEST_KNOWN


def test_root_kinds():
    assert markup.blocks("<span id=r>a<p>b</p></span>c", "r") == [("a", "body", "span"), ("b", "body", "p")]
    assert markup.blocks("<nav><div id=r><p>b</div></nav>", "r") == [("b", "body", "p")]
    assert markup.blocks("<p id=r hidden>b", "r") == [] and markup.blocks("<img id=r>b", "r") == []


def test_html_documents_and_errors(spark):
    pages = [(1, PAGE.encode()), (2, b"\xff\xfe"), (3, None), (4, b"<p>x</p>"), (4, b"<p>x</p>")]
    rows = spark.createDataFrame(pages, "doc_id long, content binary").withColumn("sha256", F.sha2("content", 256))
    got = {r["doc_id"]: r for r in html.html_documents(rows, root_id="main").collect()}
    assert [got[k]["error"]["message"] if got[k]["error"] else None for k in (1, 2, 3, 4)] == [
        None, "Primary HTML artifact is not UTF-8.", "Primary HTML artifact is missing.", "HTML root_id 'main' was not found",
    ]
    first = got[1]["segments"][0]
    sha = hashlib.sha256(PAGE.encode()).hexdigest()
    assert first["segment_id"] == hashlib.sha256(f"{sha}:0:h1:heading:Title".encode()).hexdigest()[:24]
    assert (first["role_basis"], first["boundary_before"], first["reading_order"]) == ("semantic_html:h1", "paragraph", 0)
    assert got[1]["coverage"]["matched_blocks"] == 7 and got[2]["segments"] == []


def test_support(spark):
    made = [SourceBundle.from_html(b"<p>x</p>"), SourceBundle.from_html(b"plain"), SourceBundle.from_html(b"<\xff>"), SourceBundle.from_pdf(b"%PDF-1.7"), SourceBundle.from_pdf(b"no")]
    rows = inspect_support(bundle_frame(spark, made)).collect()
    by = {(r["doc_id"], r["adapter"].split("@")[0]): (r["status"], r["reason"]) for r in rows}
    assert len(rows) == 20
    assert by[0, "semantic-html-adapter"] == ("supported", None)
    assert by[1, "semantic-html-adapter"] == ("unsupported", "Primary artifact has no HTML markup.")
    assert by[2, "word-derived-html-adapter"] == ("unsupported", "Primary HTML artifact is not UTF-8.")
    assert by[0, "pdf-adapter"] == ("unsupported", "Primary artifact kind is html; supported kinds: pdf.")
    assert by[3, "tagged-pdf-adapter"][0] == "supported"
    assert by[4, "pdf-adapter"] == ("unsupported", "Primary artifact has no PDF header.")


# ---- word-processor documents ---------------------------------------------------

W = f'xmlns:w="{fixed.WORD_NAMESPACE}"'


def p(text="", style="", sect=False, outline=None, inner=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:sectPr/>" if sect else "") + (f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else "")
    run = f"<w:r><w:t>{text}</w:t></w:r>" if text else ""
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run}{inner}</w:p>"


def char(kind):
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def instr(text):
    return f"<w:r><w:instrText>{text}</w:instrText></w:r>"


def text(t):
    return f"<w:r><w:t>{t}</w:t></w:r>"


def sdt(gallery, content=""):
    return f'<w:sdt><w:sdtPr><w:docPartObj><w:docPartGallery w:val="{gallery}"/></w:docPartObj></w:sdtPr><w:sdtContent>{content}</w:sdtContent></w:sdt>'


def table(*cells):
    return "<w:tbl>" + "".join(f"<w:tr><w:tc>{c}</w:tc></w:tr>" for c in cells) + "</w:tbl>"


def body(*blocks):
    return f"<w:document {W}><w:body>{''.join(blocks)}</w:body></w:document>"


CASES = {
    "gallery": ([sdt("Cover Pages", p("x")), sdt("Table of Contents"), sdt("other"), p("prose.")], {0: ("cover", "gallery"), 1: ("table_of_contents", "gallery")}),
    "style": ([p("Contents", "TOC Heading"), p("One", "toc 1"), p("Two", "TOC2"), p("x", "toc10")], {0: ("table_of_contents", "label"), 1: ("table_of_contents", "style"), 2: ("table_of_contents", "style")}),
    "label alone": ([p("Contents", "TOCHeading"), p("prose")], {}),
    "simple field": ([p(inner=f'<w:fldSimple w:instr=" TOC \\o">{text("a")}</w:fldSimple>'), p("x", "toc1", inner=f'<w:fldSimple w:instr="TOC">{text("a")}</w:fldSimple>')], {0: ("table_of_contents", "field")}),
    "complex field": (
        [p(inner=char("begin") + instr(" TO") + instr("C \\h") + char("separate") + text("one")), p("two", inner=char("begin") + instr("PAGEREF") + char("separate") + text("3") + char("end")), p(inner=text("three") + char("end")), p("after")],
        {0: ("table_of_contents", "field"), 1: ("table_of_contents", "field"), 2: ("table_of_contents", "field")},
    ),
    "mixed field": ([p("before", inner=char("begin") + instr("TOC") + char("separate") + text("one")), p(inner=text("two") + char("end"))], {1: ("table_of_contents", "field")}),
    "open field": ([p(inner=char("begin") + instr("TOC") + char("separate") + text("one")), p("two")], {}),
    "cut field": ([p(inner=char("begin") + instr("TOC") + char("separate") + text("one")), table(p("t")), p(inner=char("end"))], {}),
    "instruction": ([table(p() + p("Instructions for NOFO writers: do")), table(p("Agency-specific instructions")), table(p("Instructions for others")), table(p("Instructions for template managers"), p("b"))], {0: ("instruction", "table"), 1: ("instruction", "table")}),
    "cover": ([p("Name"), p(), p("Agency", sect=True), p("Contents"), p("One", "toc1")], {0: ("cover_position", "section"), 2: ("cover_position", "section"), 4: ("table_of_contents", "style")}),
    "cover prose": ([p("Name."), p("Agency", sect=True), p("One", "toc1")], {2: ("table_of_contents", "style")}),
    "cover heading": ([p("Name", "Heading1"), p("Agency", sect=True), p("One", "toc1")], {2: ("table_of_contents", "style")}),
    "cover long": ([p(" ".join(["w"] * 26)), p("Agency", sect=True), p("One", "toc1")], {2: ("table_of_contents", "style")}),
    "cover table": ([p("Name"), table(p("t")), p("Agency", sect=True), p("One", "toc1")], {3: ("table_of_contents", "style")}),
    "metadata": (
        [p("Basic Information", outline=1), p("OpDiv: x"), p("Opportunity Number: 5"), p("Metadata Author: me"), p("metadata keywords:"), p("Next", "Heading2"), p("Metadata Subject: s")],
        {3: ("metadata", "builder")},
    ),
    "metadata second run": (
        [p("Basic information", "Heading1"), p("other"), p("Before You Begin", "heading 2"), p("OPDIV: x"), p("opportunity number: 1"), p("Metadata subject: y")],
        {5: ("metadata", "builder")},
    ),
    "none": ([], {}),
}


def test_front_matter(spark):
    docs = [(k, body(*blocks)) for k, (blocks, _) in enumerate(CASES.values())] + [(100, "<broken"), (101, None), (102, "<x/>")]
    frame = spark.createDataFrame(docs, "doc_id long, xml string")
    got = {k: {} for k, _ in docs}
    for r in word.front_matter(frame).collect():
        got[r["doc_id"]][r["position"]] = (r["role"], r["basis"])
    for k, (name, (_, want)) in enumerate(CASES.items()):
        assert got[k] == want, name
    errors = {r["doc_id"]: r["word_error"] for r in word.body_blocks(frame).collect()}
    assert all(errors[k] for k in (100, 101, 102)) and errors[0] is None


def test_marks(spark):
    xml = body(p("Name"), p("Agency", sect=True), p("One", "toc1"), '<w:p><w:bookmarkStart w:id="1" w:name="scope_x"/><w:bookmarkEnd w:id="1"/></w:p>')
    row = word.marked_documents(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "doc_id long, xml string")).orderBy("doc_id").collect()
    assert sorted(row[0]["word_boundaries"].values()) == ["cover_position", "cover_position", "table_of_contents"]
    assert row[1]["marked_xml"] is None and row[2]["word_boundaries"] == {}
    marked = row[0]["marked_xml"]
    for marker in row[0]["word_boundaries"]:
        assert marked.count(f'w:name="{marker}_s"') == marked.count(f'w:name="{marker}_e"') == 1
    assert word.parse(marked)[0]["text"] == "Name"
    ids = [x.split('"')[0] for x in marked.split('bookmarkStart w:id="')[1:]]
    assert len(set(ids)) == len(ids)
    plain, none = word.mark(xml, {}, source_sha256="0" * 64)
    assert none == {} and plain.count("bookmarkStart") == 1
    assert set(word.mark(xml, {}, source_sha256="0" * 64, instruction_paragraphs=(2,))[1].values()) == {"instruction"}


def marked_html(role_ids):
    out = ""
    for n, (tag, content, role) in enumerate(role_ids):
        mark = f"scope_{'0' * 16}_{n}"
        out += f'<{tag}><a id="{mark}_s"></a>{content}<a id="{mark}_e"></a></{tag}>' if role else f"<{tag}>{content}</{tag}>"
    return out, {f"scope_{'0' * 16}_{n}": role for n, (_, _, role) in enumerate(role_ids) if role}


def test_word_html(spark):
    page, bounds = marked_html([("p", "Two words", "cover_position"), ("h1", "Contents here", "table_of_contents"), ("p", "Do this", "instruction"), ("p", "Counted words stay.", None)])
    result = analyze_one(spark, SourceBundle.from_html(page.encode()), profile="word-html@0.1.0", config={"word_boundaries": bounds})
    assert result["metrics"]["word_count"]["value"] == 3 and result["schema_version"] == "1.3.0"
    assert result["excluded_word_content"] == {k: {"words": 2, "segments": 1} for k in ("cover_position", "table_of_contents", "instruction")}
    assert result["coverage"]["role_counts"] == {"body": 1, "cover": 1, "table_of_contents": 1, "instruction": 1}
    plain = analyze_one(spark, SourceBundle.from_html(page.encode()), profile="semantic-html@0.6.0")
    assert plain["metrics"]["word_count"]["value"] == 9  # headings count as words


def test_markers_must_bound_whole_blocks():
    mark = "scope_" + "0" * 16 + "_0"
    of = lambda page: [b[1] for b in html.word_blocks(page, {mark: "cover"})[0]]
    s, e = f'<a id="{mark}_s"></a>', f'<a id="{mark}_e"></a>'
    assert of(f"<p>{s}x{e}</p>") == ["cover"]
    assert of(f"<p>y{s}x{e}</p>") == ["body"] and of(f"<p>{s}x</p><p>{e}</p>") == ["body"]
    assert of(f"<p>{s}x{e}</p><p>{s}z{e}</p>") == ["body", "body"] and of(f"<div>{s}x{e}</div>") == ["body"]
    assert of(f'<p><a id="{mark}_s"> </a>x{e}</p>') == ["body"]
    assert of(f"<li>{s}x<p>in</p>{e}</li>") == ["cover", "cover"]
    assert html.word_blocks("<p>x", {"bad": "cover"})[1] == html.BAD_BOUNDARIES and html.word_blocks("<p>x", None)[1] == html.NEEDS_BOUNDARIES


def test_golden_html(spark):
    page = b"<main id=r><h1>Two words</h1><p>Forms are reviewed by staff. Submit them early.</p><ul><li>Costs weren't approved.</li><li>No mark here</li></ul><td>Applicants submit forms.</td></main>"
    result = analyze_one(spark, SourceBundle.from_html(page), profile="semantic-html@0.6.0", config={"root_id": "r"}, document_id="d1")
    m = result["metrics"]
    assert (m["word_count"]["value"], m["words_per_sentence"]["value"], m["passive_sentence_percentage"]["value"]) == (19, 3.5, 50.0)
    assert m["passive_sentence_percentage"]["components"]["passive_sentence_count"] == 2 and m["words_per_sentence"]["components"]["paragraph_count"] == 3
    assert [w["code"] for w in result["warnings"]] == ["profile_provisional", "unterminated_semantic_fragments_excluded"]
    assert "reviewed" not in str(result) and result["source"]["document_id"] == "d1"
    older = analyze_one(spark, SourceBundle.from_html(page), profile="semantic-html@0.4.0", config={"root_id": "r"})
    assert older["metrics"]["passive_sentence_percentage"]["value"] == 25.0
    fk = analyze_one(spark, SourceBundle.from_html(b"<p>Applications must be reviewed by staff.</p><p>Submit complete forms.</p>"), profile="semantic-html@0.6.0")
    assert fk["metrics"]["flesch_kincaid_grade_level"]["value"] == 5.83 and fk["metrics"]["words_per_sentence"]["components"]["syllable_count"] == 15


def test_a_bad_source_stops_no_other(spark):
    made = [SourceBundle.from_html(b"<p>Good text here.</p>"), SourceBundle.from_html(b"no markup"), SourceBundle.from_html(b"<p>.</p>"), SourceBundle.from_pdf(b"%PDF-")]
    rows = analyze(bundle_frame(spark, made), "semantic-html@0.6.0").orderBy("doc_id").collect()
    assert [r["error"]["code"] if r["error"] else None for r in rows] == [None, "adapter_contract_error", "analysis_error", "adapter_contract_error"]
    assert rows[0]["metrics"]["word_count"]["value"] == 3 and rows[1]["metrics"] is None


def test_pages_are_parsed_in_small_parts():
    import pyarrow as pa

    from prosegauge.sources import html

    sizes = [10, 0, html.PART_BYTES + 5, html.PART_BYTES // 2, html.PART_BYTES // 2, 7, *[1] * (html.PART_ROWS + 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([b"x" * n if n else None for n in sizes], pa.binary())], names=["doc_id", "content"])
    parts = list(html.page_parts([batch, batch.slice(0, 0)], 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(sizes)))
    assert [p.num_rows for p in parts[:4]] == [2, 1, 2, html.PART_ROWS] and len(parts) == 5
