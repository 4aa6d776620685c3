"""Each pipeline stage against a brute-force version on its own input."""

import itertools
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import test_llm_operators as by_hand  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from prosegauge.llm import mixing, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    sentence = lambda: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randrange(2, 9))) for _ in range(9)).capitalize() + "."
    prose = lambda n: " ".join(sentence() for _ in range(n))
    texts, labels = [], []
    for k in range(160):
        good = k % 4 > 0
        text = prose(rng.randrange(6, 20))
        texts.append(text if good else re.sub(r"\W+", "### ", text.upper()))
        labels.append((k, int(good), 0))
    leak = prose(4)
    items = [(0, leak), (1, prose(4)), (2, None)]
    texts += [texts[5] + " Tail here.", texts[6], texts[7].upper(), f"{prose(30)} {leak} {prose(30)}"]
    texts += [f"Shared boilerplate line\n{prose(8)}\n  SHARED boilerplate line" for _ in range(12)]
    texts += [None, "", " \n ", prose(2500)]
    rows = [(k, t, ("en", None)[k % 5 == 0], ("hot", "hot", "b", None)[k % 4], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[9], (None, prose(9), "en", "b", 0), (500, prose(9), None, None, None)]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    (n1, s1), (n2, s2), (n3, s3), (n4, s4), (n5, s5) = P.STAGES
    assert [n1, n2, n3, n4, n5] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    # further columns whose names clash with those of the operators
    clash = docs.selectExpr("*", "text AS kept_text", "1 AS _score", "2 AS n_dropped", "3 AS taken", "4 AS component_id", "5 AS blocks")

    model = quality.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = [r for r in rows if model.score((r[1] or "").encode()) >= 0.5]
    got = s1(spark, clash, path)
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=str)
    junk = {k for k in range(160) if k % 4 == 0}
    assert len(junk & {r[0] for r in want}) <= 2 and sum(r[0] in range(160) for r in want) >= 116

    kept = {(r[0], r[3]) for r in by_hand.lines_by_hand([(r[0], r[1]) for r in rows if r[0] is not None], 10, keep_first=True)}
    got = s2(spark, clash, path)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["text"] or "") for r in got.where("doc_id is not null").collect()} == kept and got.count() == len(rows)
    assert sum((r["text"] or "").lower().count("shared boilerplate line") for r in got.collect()) == 1

    sets = {r[0]: by_hand.shingles_by_hand(r[1]) for r in rows if r[0] is not None}
    alike = lambda a, b: a == b or len(a & b) / max(1, len(a | b)) >= 0.8
    of = by_hand.union([(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])], sets)
    got = s3(spark, clash, path)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted((r for r in rows if r[0] is None or of[r[0]] == r[0]), key=str)

    hit = {r[0] for r in by_hand.windows_by_hand([(r[0], r[1]) for r in rows if r[0] is not None], items) if r[2]}
    got = s4(spark, clash, path)
    assert got.columns == docs.columns and hit == {163}
    assert rows_of(got) == sorted((r for r in rows if r[0] not in hit), key=str)

    got = s5(spark, clash, path).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 < r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = dict(zip(order, mixing.share_targets([sizes[s] for s in order], [5, 2, 1], sum(sizes.values()), 3)))
    largest = max(len((r[1] or "").split()) for r in rows)
    assert all(abs(taken[s] - t) <= largest for s, t in targets.items())


def test_run_is_the_stages_in_order(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
    assert rows_of(P.run(spark, path)) == rows_of(docs)


def test_nothing_in_nothing_out(spark, folder):
    path = folder[0]
    empty = spark.createDataFrame([], SCHEMA)
    assert [stage(spark, empty, path).count() for _, stage in P.STAGES] == [0] * 5


def test_short_items_take_only_what_they_fill(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(13))
    prose = " ".join(f"w{k}" for k in range(400))
    spark.createDataFrame([(0, "Yes"), (1, "blue whale"), (2, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"{prose} yes {prose}", "A blue whale", f"{prose} {passage} {prose}", f"{prose} blue {prose} whale", "yes"]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in P.decontamination_stage(spark, docs, str(tmp_path)).collect()} == {0, 3}
