"""Counts of batches of texts against the slow reading and against the built-in expressions."""

import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import slow  # noqa: E402
from test_text import column, random_texts  # noqa: E402

from prosegauge.functions import chunks, lines, passive, sentences  # noqa: E402
from prosegauge.functions.chars import BLOCK, SENTENCE  # noqa: E402
from prosegauge.operators import measure  # noqa: E402
from prosegauge.plans import fixtures, queries  # noqa: E402


def test_totals_equal_the_slow_reading():
    for text in random_texts(3000) + [t for t in fixtures.TEXTS if t]:
        words = slow.tokens(text)
        assert chunks.totals(text) == (len(words), sum(map(len, words)), sum(map(slow.syllables, words))), text


def test_what_is_known_is_bounded(monkeypatch):
    monkeypatch.setattr(chunks, "MOST_KNOWN", 3)
    known = chunks._Known(1)
    want = [known[w] for w in ("one", "two.", "three", "four,", "x" * 65, "one")]
    assert len(known) <= 3 and "x" * 65 not in known and want[0] == want[-1]


def test_batches_count_as_expressions_do(spark):
    texts = random_texts(300) + [t for t in fixtures.TEXTS] + ["", None, "...\nno. 5 is\n\n It was made. They're asked to wait.", "As defined by law, it holds. X"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for version in passive.VERSIONS:
        want = measure.line_readability(docs, version=version)
        got = measure.line_readability(docs, version=version, batches=True)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_readability_queries_count_in_batches(spark, tmp_path):
    rows = [(1, "Some words here. They were made.", "en", "a", 32)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("doc_readability", "readability_by_lang", "readability_by_source", "readability_vs_labels", "html_readability", "metric_results", "reliability_levels", "token_counts_by_doc", "passive_version_diff"):
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name  # one pass through the workers, whatever is counted


def test_unfinished_lines_cost_no_more_than_their_length(spark):
    text = "Done. " + "word " * 60_000
    began = time.perf_counter()
    assert column(spark, [text], sentences.sentences) == [["Done."]]
    assert time.perf_counter() - began < 20  # minutes when each place was searched to the end


def test_sentences_of_several_blocks(spark):
    marked = F.lit(f"One.{SENTENCE} Two!{SENTENCE} left{BLOCK}only left{BLOCK}{BLOCK}Three.{SENTENCE}")
    assert column(spark, ["x"], lambda x: sentences.sentence_array(marked)) == [["One.", "Two!", "Three."]]


def test_long_lines_are_not_cut_to_words_for_their_role(spark):
    docs = spark.createDataFrame([("Page ４ of 9",), ("PAGE 4",), ("4",), ("ﬁne 4",), ("Page four",), ("A Heading",), ("A" * 81,), (None,)], "text string")
    rows = docs.select("text", lines.is_page_number(F.col("text")).alias("number"), lines.is_heading_shape(F.col("text")).alias("heading"))
    assert [(r["number"], r["heading"]) for r in rows.collect()] == [
        (True, False), (True, True), (True, False), (False, False), (False, False), (False, True), (False, False), (None, None)
    ]
    heading = str(lines.is_heading_shape(F.col("text")))
    assert heading.index("length") < heading.index("regexp_count")
