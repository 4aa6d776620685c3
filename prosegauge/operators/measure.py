"""Counts and metrics of documents.

Counts first, then one division: scores of parts are never averaged.  A document's
text comes as one string whose blocks end with ``BLOCK``; every count is a pattern
count or an array size over it, so a document costs a fixed number of passes and
nothing is exploded or shuffled.  With ``batches`` an Arrow function makes the same
counts of known chunks (``functions.chunks``), in a fraction of the time.

Defined cases: null text counts as empty; without sentences or words the ratios are
null; sentences without any word are an ``analysis_error`` (``count_error``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions import chunks, passive, sentences, tokens, v1

COUNTS = ("readability_word_count", "sentence_count", "paragraph_count", "fragment_count", "character_count", "syllable_count", "passive_sentence_count")


def with_counts(df: DataFrame, readability: str, *, content: str | None = None, version: int | None = 5, prefix: str = "", batches: bool = False) -> DataFrame:
    """``df`` with the counts of its ``readability`` blocks and, if ``content`` is
    given, ``word_count`` of those.

    Each step is a projection of its own, so what a step makes is made once.
    ``version`` None leaves passive sentences out.
    """
    if batches:
        return with_batch_counts(df, {prefix: (readability, content)}, version=version)
    kept = df.columns
    p = prefix
    long = lambda c, name: c.cast("long").alias(p + name)
    extra = [F.col(content).alias("_own_content")] if content else []
    own = [F.size("_words").cast("long").alias(p + "word_count")] if content else []
    x = df.select(*kept, *extra, sentences.marked(F.coalesce(F.col(readability), F.lit(""))).alias("_marked"))
    x = x.select(
        *kept,
        *([tokens.tokens(F.coalesce("_own_content", F.lit(""))).alias("_words")] if content else []),
        long(sentences.sentence_count(F.col("_marked")), "sentence_count"),
        long(sentences.paragraph_count(F.col("_marked")), "paragraph_count"),
        long(sentences.fragment_count(F.col("_marked")), "fragment_count"),
        sentences.only_sentences(F.col("_marked")).alias("_sentences"),
    )
    done = [p + c for c in ("sentence_count", "paragraph_count", "fragment_count")]
    words = ["_words"] if content else []
    x = x.select(
        *kept,
        *words,
        *done,
        tokens.tokens(F.col("_sentences")).alias("_tokens"),
        *([passive.canonical(F.col("_sentences")).alias("_canonical")] if version else []),
    )
    return x.select(
        *kept,
        *own,
        long(F.size("_tokens"), "readability_word_count"),
        *done,
        long(tokens.char_total(F.col("_tokens")), "character_count"),
        long(tokens.syllable_total(F.col("_tokens")), "syllable_count"),
        *([long(passive.passive_count(F.col("_canonical"), version), "passive_sentence_count")] if version else []),
    )


def with_batch_counts(df: DataFrame, scopes: dict[str, tuple[str, str | None]], *, version: int | None = 5, words: tuple[str, ...] = ()) -> DataFrame:
    """``with_counts`` of several scopes (by prefix: readability and content), and columns
    ``words`` as numbers of words, by one pass through the workers."""
    kept = [c for c in df.columns if c not in words]
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    contents = {p: content for p, (_, content) in scopes.items() if content}
    x = df.select(
        *df.columns,
        *[text(content).alias(f"_made_{p}content") for p, content in contents.items()],
        *[sentences.marked(text(readability)).alias(f"_made_{p}marked") for p, (readability, _) in scopes.items()],
    )
    x = x.select(
        *kept,
        *[chunks.total_struct(F.col(name)).alias(name) for name in words],
        *[chunks.total_struct(F.col(f"_made_{p}content")).alias(f"_made_{p}own") for p in contents],
        *[chunks.count_struct(F.col(f"_made_{p}marked")).alias(f"_made_{p}counts") for p in scopes],
    )
    made = [F.col(name)["words"].alias(name) for name in words]
    for p in scopes:
        counts = F.col(f"_made_{p}counts")
        found = {name: counts[name] for name in chunks.COUNTS}
        if version:
            found["passive_sentence_count"] = passive.passive_count(passive.canonical(counts["may_be_passive"]), version).cast("long")
        own = [F.col(f"_made_{p}own")["words"].alias(p + "word_count")] if p in contents else []
        made += own + [found[name].alias(p + name) for name in COUNTS if name in found]
    return x.select(*kept, *made)


def metric_columns(prefix: str = "", passive_count: bool = True) -> dict[str, Column]:
    """The five ratios of a document's counts."""
    c = lambda name: F.col(prefix + name)
    per_sentence = F.try_divide(c("readability_word_count"), c("sentence_count"))
    per_word = F.try_divide(c("syllable_count"), c("readability_word_count"))
    base, by_length, by_syllables = map(F.lit, fixed.EASE)
    length, syllables, less = map(F.lit, fixed.GRADE)
    out = {
        "words_per_sentence": per_sentence,
        "characters_per_word": F.try_divide(c("character_count"), c("readability_word_count")),
        "flesch_reading_ease": base - by_length * per_sentence - by_syllables * per_word,
        "flesch_kincaid_grade_level": length * per_sentence + syllables * per_word - less,
    }
    if passive_count:
        out["passive_sentence_percentage"] = F.try_divide(F.lit(100).cast("long") * c("passive_sentence_count"), c("sentence_count"))
    return {prefix + name: column for name, column in out.items()}


def count_error(prefix: str = "") -> Column:
    """Message where counts contradict each other, else null."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when((c("sentence_count") > 0) & (c("readability_word_count") == 0), "sentences require readability words")
        .when((c("readability_word_count") == 0) & ((c("character_count") > 0) | (c("syllable_count") > 0)), "characters and syllables require readability words")
        .when(c("passive_sentence_count") > c("sentence_count"), "passive sentences must not exceed sentences")
    )


def line_readability(docs: DataFrame, *, text: str = "text", version: int = 5, batches: bool = False) -> DataFrame:
    """Readability of plain documents whose lines are blocks: the columns of
    ``docs`` but the text, counts, metrics and ``sentences_per_paragraph``."""
    kept = [c for c in docs.columns if c != text]
    blocks = docs.select(*kept, sentences.line_blocks(F.coalesce(F.col(text), F.lit(""))).alias("_blocks"))
    made = with_counts(blocks, "_blocks", content="_blocks", version=version, batches=batches).drop("_blocks")
    return made.withColumns(metric_columns() | {"sentences_per_paragraph": F.try_divide(F.col("sentence_count"), F.col("paragraph_count"))})


def readability_by(docs: DataFrame, *keys: str) -> DataFrame:
    """Readability of groups of documents, of their summed counts (``line_readability``
    rows in).  Sums are combined before the exchange, so a hot group is no load."""
    sums = docs.groupBy(*keys).agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("word_count", *COUNTS)])
    return sums.withColumns(metric_columns())


def v1_readability(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The first-generation counts and ratios of whole texts."""
    kept = [c for c in docs.columns if c != text]
    x = docs.select(*kept, v1.v1_words(F.coalesce(F.col(text), F.lit(""))).alias("_w"), v1.v1_sentences(F.coalesce(F.col(text), F.lit(""))).alias("_s"))
    x = x.select(
        *kept,
        F.size("_w").cast("long").alias("readability_word_count"),
        F.size("_s").cast("long").alias("sentence_count"),
        v1.v1_char_total(F.col("_w")).cast("long").alias("character_count"),
        v1.v1_syllable_total(F.col("_w")).cast("long").alias("syllable_count"),
    )
    return x.withColumns(metric_columns(passive_count=False)).withColumnsRenamed({"readability_word_count": "word_count", "flesch_kincaid_grade_level": "flesch_kincaid_grade"})
