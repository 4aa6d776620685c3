"""Profiles, registry, contracts, sinks, command line, streaming and small hard cases."""

import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from prosegauge import cli, fixed
from prosegauge.errors import AdapterContractError, AdapterNotFoundError, InputError, ProfileError
from prosegauge.operators import measure, selection
from prosegauge.plans import contracts, result_schema
from prosegauge.plans.analyze import analysis_results, analyze, measure_documents, metric_rows, plain_documents
from prosegauge.plans.registry import ADAPTERS, HTML, Adapter, AdapterRegistry, choose_adapter, configuration_sha256, list_adapters
from prosegauge.sources import files, sinks
from prosegauge.sources.profiles import Profile, Rule, all_profiles, list_profiles, load_profile
from prosegauge.streaming import readability


def test_profiles():
    assert len(list_profiles()) == 10 and list_profiles() == sorted(list_profiles())
    for p in all_profiles().values():
        assert Profile.from_dict(json.loads(p.document)) == p and len(p.sha256) == 64
        estimate = "pdf" in p.id
        assert ("unknown" in p.rules["word_count"].include) == estimate and p.passive_version in (3, 4, 5)
        assert "heading" in p.rules["word_count"].include and "heading" not in p.rules["words_per_sentence"].include
    with pytest.raises(ProfileError):
        load_profile("semantic-html@9.9.9")
    one = load_profile("semantic-html@0.6.0").to_dict()
    one["methods"]["tokenizer"]["version"] = "2.0.0"
    with pytest.raises(ProfileError):
        Profile.from_dict(one).passive_version  # noqa: B018
    one["metrics"]["words_per_sentence"] = one["metrics"]["word_count"]
    with pytest.raises(ProfileError):
        Profile.from_dict(one).scope_rule("readability_sentences")
    for include, policy in ((("body",), "warn_and_include"), (("unknown",), "unable_to_calculate"), (("body", "body"), "warn_and_exclude")):
        with pytest.raises(ValueError):
            Rule(include, tuple(r for r in fixed.ROLES if r not in include), policy)


def test_registry():
    assert [a["reference"] for a in list_adapters()] == sorted(a["reference"] for a in list_adapters())
    assert ADAPTERS.resolve("html") is ADAPTERS.resolve("semantic-html-adapter") is HTML
    with pytest.raises(AdapterNotFoundError):
        ADAPTERS.resolve("nothing")
    twin = Adapter(HTML.id, "0.2.0", HTML.source_kinds, HTML.capabilities, HTML.support, HTML.extract)
    with pytest.raises(AdapterContractError, match="ambiguous"):
        AdapterRegistry([HTML, twin]).resolve(HTML.id)
    with pytest.raises(AdapterContractError, match="duplicate"):
        AdapterRegistry([HTML, HTML])
    with pytest.raises(AdapterContractError):
        choose_adapter(load_profile("semantic-html@0.6.0"), "pdf")
    assert choose_adapter(load_profile("generic-pdf-estimate@0.6.0"), "tagged-pdf")[1].id == "tagged-pdf-adapter"
    for wrong in ({"id": "bad id"}, {"version": "1"}, {"source_kinds": ()}, {"capabilities": ("magic",)}):
        with pytest.raises(ValueError):
            Adapter(**{"id": "x", "version": "1.0.0", "source_kinds": ("a",), "capabilities": (), "support": None, "extract": None} | wrong)


def test_configuration_hash():
    assert configuration_sha256({"b": 1, "a": [None, "é"]}) == configuration_sha256({"a": [None, "é"], "b": 1})
    for wrong in ({"a": {1: 2}}, {"a": (1,)}, {"a": float("nan")}, {"a": {1}}):
        with pytest.raises(AdapterContractError):
            configuration_sha256(wrong)


def test_sources(tmp_path, spark):
    path = tmp_path / "a.html"
    path.write_bytes(b"<p>x</p>")

    class Stream(io.BytesIO):
        def seek(self, *a):
            raise OSError

    stream = io.BytesIO(b"abc")
    stream.read(2)
    got = [files.SourceBundle.from_html(s).primary.read() for s in (path, str(path), bytearray(b"y"), memoryview(b"z"), stream, Stream(b"tail"))]
    assert got == [b"<p>x</p>", b"<p>x</p>", b"y", b"z", b"abc", b"tail"] and stream.tell() == 2
    for wrong, text in ((tmp_path / "none", "no such file"), (io.StringIO("t"), "not of bytes"), (5, "no path, bytes or stream")):
        with pytest.raises(InputError, match=text):
            files.SourceBundle.from_html(wrong).primary.read()
    with pytest.raises(ValueError):
        files.SourceArtifact("Bad", "pdf", b"")
    with pytest.raises(ValueError):
        files.SourceBundle(files.SourceArtifact("other", "pdf", b""))
    read = files.read_files(spark, str(tmp_path), "html").first()
    assert read["byte_length"] == 8 and read["production_path"].endswith("a.html") and read["artifacts"][0]["sha256"] == read["sha256"]
    bundle = files.SourceBundle(files.SourceArtifact("primary", "html", b"<p>x</p>"), (files.SourceArtifact("extra", "json", b"{}"),))
    assert bundle.artifact("extra").kind == "json"
    row = analyze(files.bundle_frame(spark, [bundle]), "semantic-html@0.6.0").first()
    assert "does not accept auxiliary artifacts" in row["error"]["message"]


TOON = [
    (None, "null"), (True, "true"), (-0.0, "0"), (1.50, "1.5"), (1e-7, "1e-7"), (1e21, "1e+21"), (float("inf"), "null"), ("", '""'), ("a b", "a b"),
    ("1e5", '"1e5"'), ("-x", '"-x"'), ("a,b", '"a,b"'), ("true", '"true"'), (" a", '" a"'), ("q\"\\\n", '"q\\"\\\\\\n"'), ([], "[]"), ([1, "a"], "[2]: 1,a"),
    ({}, ""), ({"a": 1, "b c": {"d": []}}, 'a: 1\n"b c":\n  d: []'),
    ([{"a": 1, "b": 2}, {"b": 4, "a": 3}], "[2]{a,b}:\n  1,2\n  3,4"),
    ({"x": {"p": {"v": 1}, "q": {"v": 2}}}, "x[2:]{v}:\n  p: 1\n  q: 2"),
    ({"p": {"v": 1}, "q": {"v": 2}}, "[2:]{v}:\n  p: 1\n  q: 2"),
    ({"l": [{"a": 1}, {"b": [1, 2]}, [3], [], {}]}, "l[5]:\n  - a: 1\n  - b[2]: 1,2\n  - [1]: 3\n  - [0]:\n  -"),
    ([{"a": {"b": 1}, "c": 2}], "[1]:\n  - a:\n      b: 1\n    c: 2"),
]


@pytest.mark.parametrize("value,text", TOON)
def test_compact_text(value, text):
    assert sinks.encode_toon(value) == text


def test_compact_text_refuses():
    for wrong in ("\ud800", {"a": object()}, [object()]):
        with pytest.raises((ValueError, TypeError)):
            sinks.encode_toon(wrong)


def test_write_json(tmp_path):
    target = sinks.write_json(tmp_path / "d" / "r.json", {"é": 1})
    assert target.read_text() == '{\n  "é": 1\n}\n'
    with pytest.raises(TypeError):
        sinks.write_json(target, {"x": object()})
    assert target.read_text() == '{\n  "é": 1\n}\n' and len(list(target.parent.iterdir())) == 1


def test_command_line(tmp_path, capsys, spark):
    page, out = tmp_path / "p.html", tmp_path / "r.json"
    page.write_text("<p>Forms are reviewed by staff.</p>")

    def run(*args):
        code = cli.main([*map(str, args)])
        return code, capsys.readouterr().out

    code, text = run("--json", "analyze", page, "--source-kind", "html", "--profile", "semantic-html@0.6.0", "--output", out)
    assert code == 0 and json.loads(text)["status"] == "ok" and json.loads(out.read_text())["metrics"]["word_count"]["value"] == 5
    assert run("--json", "profiles", "list")[1].count("@") == 10 and "tokenizer" in run("profiles", "show", "word-html@0.1.0")[1]
    assert json.loads(run("--json", "adapters", "list")[1])["count"] == 4 and "reference: pdf-adapter@0.4.0" in run("adapters", "show", "pdf-adapter")[1]
    assert json.loads(run("--json", "adapters", "inspect", page, "--source-kind", "html")[1])["assessment_count"] == 4
    assert run()[0] == 0
    for args, code, kind in (
        (("analyze", page, "--output", out), 2, "usage_error"),
        (("nothing",), 2, "usage_error"),
        (("--json", "--json"), 2, "usage_error"),
        (("profiles", "show", "x@1"), 1, "profile_error"),
        (("adapters", "show", "x"), 1, "input_error"),
        (("analyze", tmp_path / "no.html", "--source-kind", "html", "--profile", "semantic-html@0.6.0", "--output", out), 1, "input_error"),
        (("adapters", "inspect", page, "--aux", "bad"), 1, "input_error"),
        (("analyze", page, "--profile", "pdf-estimate@0.7.0", "--output", out), 1, None),
    ):
        got, text = run(*args)
        assert got == code and (kind is None or kind in text), args


def test_conformance(spark):
    sources = files.bundle_frame(spark, [files.SourceBundle.from_html(b"<p>x y.</p>")])
    assert contracts.conformance(HTML, sources)["checks"] == list(contracts.CHECKS)

    def broken(change):
        def extract(s, config):
            return change(HTML.extract(s, config))

        return Adapter("own", "1.0.0", ("html",), ("text",), HTML.support, extract)

    seg = lambda f: lambda d: d.withColumn("segments", F.transform("segments", f))
    for change, text in (
        (seg(lambda s: s.withField("inclusion_override", F.lit(True))), "inclusion_override"),
        (seg(lambda s: s.withField("role", F.lit("odd"))), "unsupported role"),
        (lambda d: d.withColumn("coverage", F.col("coverage").withField("status", F.lit("failed"))), "failed coverage"),
        (lambda d: d.withColumn("dependencies", F.create_map(F.lit("x"), F.lit(""))), "dependency names"),
        (seg(lambda s: s.withField("segment_id", F.uuid())), "not deterministic"),
    ):
        with pytest.raises(AdapterContractError, match=text):
            contracts.conformance(broken(change), sources)
    with pytest.raises(AdapterContractError):
        contracts.conformance(HTML, files.bundle_frame(spark, [files.SourceBundle.from_html(b"none")]))


HARD = [(1, None), (2, ""), (3, " \n \t"), (4, "No mark"), (5, "One. Two! Three?"), (6, "x " * 20000 + "."), (5, "One. Two! Three?"), (None, "Null id here.")]


def test_hard_documents(spark):
    docs = spark.createDataFrame([(*r, "clash", 0) for r in HARD], "doc_id long, text string, word string, sentence_count_of string")
    got = sorted(measure.line_readability(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["word_count"], r["sentence_count"], r["fragment_count"]) for r in got] == [(0, 0, 0)] * 3 + [(2, 0, 1), (3, 3, 0), (3, 3, 0), (20000, 1, 0), (3, 1, 0)]
    assert got[0]["words_per_sentence"] is None and got[0]["word"] == "clash"
    assert measure.line_readability(docs.limit(0)).count() == 0 == measure.v1_readability(docs.limit(0)).count()
    assert [r["word_count"] for r in measure.v1_readability(docs.where("doc_id = 5")).collect()] == [3, 3]
    profile = load_profile("semantic-html@0.6.0")
    rows = metric_rows(measure_documents(plain_documents(docs.where("doc_id < 4")), profile), profile)
    assert {r["status"] for r in rows.where("metric_id <> 'word_count'").collect()} == {"unable_to_calculate"}
    sums = measure.readability_by(measure.line_readability(docs), "word").first()
    assert sums["documents"] == 8 and sums["word_count"] == 20011


def test_selection(spark):
    rows = [(1, 0, "a", "body", "none", None), (1, 1, "b", "heading", "page", None), (1, 2, "c", "footer", "line", True), (1, 3, "d", "body", "line", False), (2, 0, "e", "unknown", "none", None)]
    segments = spark.createDataFrame(rows, "doc_id long, reading_order int, text string, role string, boundary_before string, inclusion_override boolean")
    rules = selection.rules_frame(spark, [load_profile("semantic-html@0.6.0")])
    assert rules.count() == 72
    got = {(r["doc_id"], r["metric_id"]): r for r in selection.selection_summary(segments, rules).collect()}
    assert (got[1, "word_count"]["included_segment_count"], got[1, "word_count"]["excluded_segment_count"], got[1, "word_count"]["unable"]) == (3, 1, False)
    assert got[1, "flesch_reading_ease"]["included_segment_count"] == 2 and got[2, "word_count"]["unable"]
    texts = {(r["doc_id"], r["metric_id"]): r["text"] for r in selection.joined_text(selection.selected(segments, rules)).collect()}
    assert texts[1, "word_count"] == "a\n\nb\nc" and texts[1, "words_per_sentence"] == "a\nc"


def test_plan_is_narrow(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    measure.line_readability(docs.select("doc_id", "text")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_results_hold_no_text(spark):
    docs = spark.createDataFrame([(1, "Zebras are counted.\nA fragment zebra")], "doc_id long, text string")
    profile = load_profile("semantic-html@0.6.0")
    made = plain_documents(docs)
    for name, kind in (("kind", "string"), ("sha256", "string"), ("byte_length", "bigint"), ("production_path", "string"), ("document_id", "string"), ("revision", "string")):
        made = made.withColumn(name, F.lit(None).cast(kind))
    made = made.withColumn("artifacts", F.array())
    result = analysis_results(measure_documents(made, profile), profile)
    assert contracts.result_violations(result).count() == 0
    assert "ebra" not in sinks.json_lines(result).first()["json"]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(k, "One is made. Two", "en" if k % 2 else "de") for k in range(6)], "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = readability.read_documents(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    readability.run_to_end(readability.document_metrics(stream.select("doc_id", "text")), "stream_docs", str(tmp_path / "c1"))
    assert sorted(r["passive_sentence_count"] for r in spark.table("stream_docs").collect()) == [1] * 6
    readability.run_to_end(readability.running_totals(stream, "lang"), "stream_langs", str(tmp_path / "c2"), "complete")
    assert {r["lang"]: (r["documents"], r["passive_sentence_percentage"]) for r in spark.table("stream_langs").collect()} == {"en": (3, 100.0), "de": (3, 100.0)}


def test_schemas(spark):
    sources = files.bundle_frame(spark, [files.SourceBundle.from_html(b"<p>Forms are reviewed. It ends.</p>")])
    plain = analyze(sources, "semantic-html@0.6.0")
    result_schema.check_results(plain, "1.1.0")
    assert contracts.result_violations(plain).collect() == []
    word = analyze(sources, "word-html@0.1.0", config={"word_boundaries": {}})
    result_schema.check_results(word, "1.3.0")
    with pytest.raises(AdapterContractError, match="excluded_word_content is unknown"):
        result_schema.check_results(word, "1.1.0")
    with pytest.raises(AdapterContractError, match="metrics.word_count.value is string"):
        metrics = F.col("metrics").withField("word_count", F.col("metrics.word_count").withField("value", F.lit("x")))
        result_schema.check_results(plain.withColumn("metrics", metrics), "1.1.0")
    for p in all_profiles().values():
        read = spark.createDataFrame([(p.document.decode(),)], "d string").select(F.from_json("d", result_schema.profile_schema()).alias("d")).first()["d"].asDict(True)
        said = json.loads(p.document)
        assert {k: read[k] for k in said if k not in ("methods", "metrics")} == {k: v for k, v in said.items() if k not in ("methods", "metrics")}
        assert read["metrics"] == said["metrics"] and {s: {k: v for k, v in m.items() if v is not None} for s, m in read["methods"].items()} == said["methods"]


def test_results_that_contradict_themselves(spark):
    sources = files.bundle_frame(spark, [files.SourceBundle.from_html(b"<p>Forms are reviewed. It ends.</p>")])
    good = analyze(sources, "semantic-html@0.6.0")
    for column, change, fault in (
        ("coverage", lambda c: c.withField("unknown_role_count", F.lit(1).cast("bigint")), "unknown_role_count must be"),
        ("coverage", lambda c: c.withField("segments_total", F.lit(-1).cast("bigint")), "negative"),
        ("profile", lambda c: c.withField("sha256", F.lit("x")), "SHA-256"),
        ("source", lambda c: c.withField("byte_length", F.lit(7).cast("bigint")), "primary artifact"),
        ("adapter", lambda c: c.withField("capabilities_used", F.array(F.lit("pdf_structure"))), "declared"),
        ("warnings", lambda c: F.transform(c, lambda w: w.withField("message", F.lit(" "))), "complete"),
        ("selection", lambda c: c.withField("word_count", c["word_count"].withField("included_segment_count", F.lit(5).cast("bigint"))), "all segments"),
    ):
        found = [r["violation"] for r in contracts.result_violations(good.withColumn(column, change(F.col(column)))).collect()]
        assert any(fault in f for f in found), (fault, found)


def test_what_adapters_took(spark):
    sources = files.bundle_frame(spark, [files.SourceBundle.from_html(b"<p>x y.</p>")])

    def changed(**columns):
        return Adapter("own", "1.0.0", ("html",), ("text",), HTML.support, lambda s, config: HTML.extract(s, config).withColumns(columns))

    for columns, text in (
        ({"artifacts_consumed": F.array(F.lit("other"))}, "include the primary"),
        ({"artifacts_consumed": F.array(F.lit("primary"), F.lit("other"))}, "those of the source"),
        ({"capabilities_used": F.array(F.lit("pdf_structure"))}, "declared"),
        ({"sha256": F.lit("0" * 64)}, "identity of the source"),
    ):
        with pytest.raises(AdapterContractError, match=text):
            contracts.conformance(changed(**columns), sources)
    fine = changed(artifacts_consumed=F.array(F.lit("primary")), capabilities_used=F.array(F.lit("text")))
    assert contracts.conformance(fine, sources)["conformant"]


def test_times_are_universal(spark):
    sources = files.bundle_frame(spark, [files.SourceBundle.from_html(b"<p>x y.</p>")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        said = analyze(sources, "semantic-html@0.6.0").first()["generated_at"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    apart = datetime.datetime.now(datetime.UTC) - datetime.datetime.fromisoformat(said)
    assert said.endswith("Z") and abs(apart.total_seconds()) < 120
