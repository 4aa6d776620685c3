"""The first-generation method set: ASCII words, prose joined over lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import BLOCK, all_of, count_of, in_class, strip
from prosegauge.functions.tokens import folded_syllables, word_syllables

_HIDDEN, _ITEM = "\ue000", "\ufdd3"
_LIST_LINE = rf"(?m)^(?:[{in_class(fixed.V1_LIST_MARKS)}]|\(?\p{{Nd}}{{1,3}}[.)])[{fixed.WS}&&[^\n]]+(.*)$"


def v1_words(text: Column) -> Column:
    """Array of words of ASCII letters with inner apostrophes and hyphens."""
    return all_of(text, fixed.V1_WORD)


def v1_syllables(word: Column) -> Column:
    return word_syllables(F.lower(word))


def v1_syllable_total(words: Column) -> Column:
    """Sum of ``v1_syllables`` over an array of words."""
    return folded_syllables(F.regexp_replace(F.lower(F.array_join(words, " ")), "['’-]", ""))


def v1_char_total(words: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(words, ""), "[^A-Za-z]", ""))


def v1_sentences(text: Column) -> Column:
    """Array of sentences: list items of their own, prose joined over lines and cut
    after marks; those of fewer than two words are left out."""
    lines = F.regexp_replace(F.translate(text, BLOCK + _ITEM + _HIDDEN, ""), rf"\r\n|[{fixed.OTHER_LINE_ENDS}]", "\n")
    lines = strip(F.regexp_replace(lines, rf"[{fixed.WS}&&[^\n]]*\n[{fixed.WS}&&[^\n]]*", "\n"))
    units = F.regexp_replace(lines, _LIST_LINE, f"{BLOCK}{_ITEM}$1{BLOCK}")
    units = F.regexp_replace(F.regexp_replace(units, r"\n{2,}", BLOCK), r"\n", " ")

    def parts(unit: Column) -> Column:
        prose = strip(unit)
        for word in fixed.V1_ABBREVIATIONS:
            prose = F.replace(prose, F.lit(word), F.lit(word.replace(".", _HIDDEN)))
        cut = F.split(prose, rf"(?<=[.!?])[\"')\]]*[{fixed.WS}]+")
        return F.when(unit.startswith(_ITEM), F.array(F.translate(unit, _ITEM, ""))).otherwise(
            F.transform(cut, lambda p: F.translate(p, _HIDDEN, "."))
        )

    found = F.flatten(F.transform(F.split(units, BLOCK), parts))
    return F.transform(F.filter(found, lambda s: count_of(s, fixed.V1_WORD) >= 2), lambda s: strip(s))
