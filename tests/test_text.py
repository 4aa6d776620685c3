"""Text functions against hand-made values and an independent slow reading."""

import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import slow  # noqa: E402

from prosegauge import fixed  # noqa: E402
from prosegauge.functions import lines, passive, sentences, tokens, v1  # noqa: E402
from prosegauge.functions.chars import casefold, fold, half_even  # noqa: E402
from prosegauge.plans import fixtures  # noqa: E402


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, x {kind}")
    return [r["y"] for r in rows.select("k", build(F.col("x")).alias("y")).orderBy("k").collect()]


def random_texts(n=400):
    rng = random.Random(11)
    bits = ["a", "The", "U.S.", "e.g.", "Dr.", "end.", "end!", "“Quote.”", "(in)", "x/y", "—", "•", "☐", "1.", "2.3.4.", "$1,200.50", "5%", "R2-D2"]
    bits += ["jane@x.org", "www.a.b/c", "https://a.b/c.", "made", "tables,", "agreed;", "Ünique", "straße", "Ωmega", "résumé", "SCHEDULE", "uei’s", "re-schedule"]
    bits += ["...", "?!", "''", "\"", "½", "²", "3)", "no.", "is", "are", "by", "as", "defined", "approved", "there", "quickly", "ﬁne", "ate", "eye", "n’t", "a-'b"]
    return [rng.choice([" ", "\n", " ", "  "]).join(rng.choices(bits, k=rng.randrange(0, 25))) for _ in range(n)]


def test_tokens_and_syllables_equal_the_slow_reading(spark):
    texts = random_texts() + list(fixtures.TEXTS)
    want = [slow.tokens(t) for t in texts]
    assert column(spark, texts, tokens.tokens) == want
    words = sorted({w for ws in want for w in ws} | {"make", "table", "funded", "ale", "era", "Ⅷ", "12-34", "x@y.z", "$5", "$50", "1,000", "queue", "eyes", "㎏"})
    assert column(spark, words, tokens.token_syllables) == [slow.syllables(w) for w in words]
    assert column(spark, texts, lambda t: tokens.syllable_total(tokens.tokens(t))) == [sum(map(slow.syllables, ws)) for ws in want]
    assert column(spark, texts, lambda t: tokens.char_total(tokens.tokens(t))) == [sum(map(len, ws)) for ws in want]


def test_v1_syllables(spark):
    words = ["", "made", "make", "table", "funded", "the", "area", "agreed", "goes", "dead-line", "don't"]
    assert column(spark, words, v1.v1_syllables) == [slow.estimate(w) for w in words]
    assert column(spark, [" ".join(words)], lambda t: v1.v1_syllable_total(v1.v1_words(t))) == [sum(map(slow.estimate, words))]


def test_v1_sentences(spark):
    texts = [
        "1. Apply now\n• Wait here\nA prose sentence follows.",
        "First part\nof one. Second (one.) Third one! x\n\nNew paragraph e.g. this one. Mr. Poe came.\n- item with. two parts\nrest of it",
        "",
    ]
    assert column(spark, texts, v1.v1_sentences) == [
        ["Apply now", "Wait here", "A prose sentence follows."],
        ["First part of one.", "Second (one.", "Third one!", "New paragraph e.g. this one.", "Mr. Poe came.", "item with. two parts", "rest of it"],
        [],
    ]


def test_sentences_by_hand(spark):
    texts = [
        "The U.S. plan costs $1.5 million. It ends, e.g. in May. No. 5 stays",
        "Visit https://a.example.gov. Apply now.",
        "See the U.S.",
        "He said “Stop.” Then he left!)",
        "no. 7 is here.",
        "",
        None,
    ]
    got = column(spark, texts, sentences.sentences)
    assert got == [
        ["The U.S. plan costs $1.5 million.", "It ends, e.g. in May."],
        ["Visit https://a.example.gov. Apply now."],
        ["See the U.S."],
        ["He said “Stop.”", "Then he left!)"],
        ["No. 7 is here."],
        [],
        None,
    ]
    assert column(spark, texts, sentences.fragments) == [["No. 5 stays"], [], [], [], [], [], None]


def test_counts_of_many_blocks_equal_those_of_each(spark):
    blocks = [t.replace("\n", " ") for t in random_texts(150)]
    groups = [blocks[k : k + 10] for k in range(0, 150, 10)]
    joined = ["\n".join(g) for g in groups]
    marked = lambda t: sentences.marked(sentences.line_blocks(t))
    each_s, each_f = column(spark, blocks, sentences.sentences), column(spark, blocks, sentences.fragments)
    per = lambda x: [x[k : k + 10] for k in range(0, 150, 10)]
    assert column(spark, joined, lambda t: sentences.sentence_array(marked(t))) == [sum(g, []) for g in per(each_s)]
    assert column(spark, joined, lambda t: sentences.sentence_count(marked(t))) == [sum(map(len, g)) for g in per(each_s)]
    assert column(spark, joined, lambda t: sentences.fragment_count(marked(t))) == [sum(map(len, g)) for g in per(each_f)]
    assert column(spark, joined, lambda t: sentences.paragraph_count(marked(t))) == [sum(map(bool, g)) for g in per(each_s)]
    words = column(spark, joined, lambda t: F.size(tokens.tokens(sentences.only_sentences(marked(t)))))
    assert words == [sum(len(slow.tokens(s)) for s in sum(g, [])) for g in per(each_s)]


@pytest.mark.parametrize("version", passive.VERSIONS)
def test_passive_rule(spark, version):
    rng = random.Random(version)
    bits = ["is", "are", "was", "get", "got", "there", "as", "by", "defined", "approved", "started", "need", "indeed", "uninsured", "involved", "in", "with"]
    bits += ["quickly", "not", "been", "made", "done", "you're", "isn’t", "the", "prepared", "to", "associated", ";", ".", ",", "x'y'z", "é", "read", "red", "also"]
    texts = list(fixtures.SENTENCES) + [" ".join(rng.choices(bits, k=rng.randrange(1, 10))) for _ in range(2500)]
    want = [slow.passive(t, version) for t in texts]
    assert column(spark, texts, lambda t: passive.is_passive(t, version)) == [w[0] for w in want]
    assert column(spark, texts, lambda t: passive.passive_rule(t, version)) == [w[1] for w in want]
    whole = ["".join(t + "\ufdd2" for t in texts[k : k + 50]) for k in range(0, len(texts), 50)]
    counts = [sum(w[0] for w in want[k : k + 50]) for k in range(0, len(texts), 50)]
    assert column(spark, whole, lambda t: passive.passive_count(passive.canonical(t), version)) == counts


def test_versions_by_hand(spark):
    four = ["An entity as defined by the charter.", "Forms are reviewed by staff.", "The applicant isn't excluded.", "Applicants submit forms."]
    assert [column(spark, four, lambda t, v=v: passive.is_passive(t, v)).count(True) for v in (3, 4, 5)] == [2, 3, 2]
    assert column(spark, ["It is so. It was built."], passive.is_passive) == [True]


def test_folding(spark):
    values = ["straße", "ÀÉî", "ﬁx", "ⅷ", "日本a", "x½y", "K", "𝐀b"]
    import unicodedata

    def by_hand(t):
        keep = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalpha()).lower()
        return "".join(keep(c) if c.isalnum() else c for c in t)

    assert column(spark, values, fold) == [by_hand(v) for v in values]
    assert column(spark, ["Straße", "ſet", "ΑΣ", "ﬀ"], casefold) == ["strasse", "set", "Ας".casefold(), "ff"]


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    values = [n / d for n, d in ((rng.randrange(2000), rng.randrange(1, 100)) for _ in range(4000))] + [0.0, -2.675, 2.675, 4.125, 0.125, 1e15, 12.345, -0.005, 1005.005]
    for digits in (2, 4, 6):
        assert column(spark, values, lambda x, d=digits: half_even(x, d), "double") == [round(v, digits) for v in values]
    assert column(spark, [None], lambda x: half_even(x, 2), "double") == [None]


def test_line_predicates(spark):
    texts = ["PLAN OF x", "Plan Of The Work", "Plan of", "ALL CAPS 12", "12", "Ünder Öl", "aB", "McX", "Ǆa", "They'Re Good", "Page 3 of 12", "page 7", "3 of", "Intro ..... 12", "1) one", "o two", "• x", "•x", "Ends."]
    assert column(spark, texts, lines.is_title) == [t.istitle() for t in texts]
    assert column(spark, texts, lines.is_upper) == [t.isupper() for t in texts]
    got = column(spark, texts, lambda t: F.concat(*[x.cast("int").cast("string") for x in (lines.is_page_number(t), lines.is_contents_line(t), lines.is_list_line(t))]))
    assert dict(zip(texts, got)) | {} == {t: "000" for t in texts} | {"12": "100", "Page 3 of 12": "100", "page 7": "100", "Intro ..... 12": "010", "1) one": "001", "o two": "001", "• x": "001"}
    assert column(spark, ["  Page  12\tof 300 Straße "], lines.edge_key) == ["page # of # strasse"]


def test_syllable_breakdown(spark):
    got = column(spark, ["See https://a.example.org/x for $25 (R2D2), jane@x.org • schedule."], tokens.syllable_breakdown)[0]
    assert [(r["token"], r["syllables"], r["word_units"], r["reason"]) for r in got] == [
        ("See", 1, 1, "unicode_normalized_v1"),
        ("https://a.example.org/x", 1 + 1 + 3 + 1 + 1, 3, "electronic_v1_components"),
        ("for", 1, 1, "unicode_normalized_v1"),
        ("$25", 3, 1, "numeric_pattern"),
        ("R2D2", 1, 1, "mixed_identifier"),
        ("jane@x.org", 1 + 1 + 1, 1, "electronic_v1_components"),
        ("schedule", 2, 1, "exception"),
    ]


def test_normalized_white_space_of_every_kind(spark):
    spaces = [c for c in map(chr, range(0x3100)) if c in fixed.WHITESPACE]
    runs = spaces + [a + b for a in spaces for b in (" ", "\n", " ", "\x1c")] + [" ", "  ", "   ", " \t ", "\t \t", "   "]
    texts = [f"{r}a{r}é~!{r}​b{r}" for r in runs] + ["", " ", "\x1f\x85", "a b", "İ K­"]
    own = f"[{''.join(map(re.escape, fixed.WHITESPACE))}]+"
    assert column(spark, texts, lines.normalized) == [re.sub(own, " ", t).strip(" ") for t in texts]
