"""Passive sentences, three versions of one bounded rule.

A text is first brought to a canonical form: its words in lower case and, where
a gap between two words holds a clause mark, that mark, all separated by one
space; sentences end with ``SENTENCE``.  In that form the rule is one pattern:

    auxiliary (intervening word or adverb in -ly){0,4} participle
    as participle (intervening word or adverb in -ly){0,3} by

with what it excludes as look-around.  Participles are no intervening words, so
a pattern cannot step over the first participle, at which the search of an
auxiliary ends.  A sentence counts once.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import SENTENCE, all_of, count_of

VERSIONS = (3, 4, 5)
_STOP = "(?![^ ])"
_START = "(?<![^ ])"
_ANY_GAP = "(?: [.;:!?])? "


def canonical(text: Column) -> Column:
    """Words and clause marks of a text with ``SENTENCE`` marks."""
    # of all characters that are not ASCII only these two have ASCII lower forms
    plain = text
    for char, to in (("\u212a", "\ufffd"), ("\u0130", "\ufffd"), ("’", "'")):
        plain = F.replace(plain, F.lit(char), F.lit(to))
    plain = F.lower(plain)
    pieces = r"[a-z]+(?:'[a-z]+)?|[.;:!?](?=[^a-z.;:!?\x{FDD2}]*(?:[a-z\x{FDD2}]|\z))|\x{FDD2}"
    return F.array_join(all_of(plain, pieces), " ")


@cache
def _patterns(version: int) -> tuple[str, str]:
    """Finite passives (group 1: the auxiliary) and ``as ... by`` phrases."""
    if version not in VERSIONS:
        raise ValueError(f"passive rule version must be one of {VERSIONS}")
    later = version >= 4
    be = "|".join(fixed.BE_FORMS + (fixed.CONTRACTED_BE if later else ()))
    get = "|".join(fixed.GET_FORMS)
    between = f"(?: (?:{'|'.join(fixed.INTERVENING + (('indeed',) if later else ()))}|[a-z']*ly){_STOP})"
    never = f"(?!(?:{'|'.join(fixed.NO_PARTICIPLES)}){_STOP})" if later else ""
    participle = f"{never}(?:(?:{'|'.join(fixed.IRREGULAR_PARTICIPLES)})|(?=[a-z']{{4}})[a-z']*ed){_STOP}"
    states = "|".join(f"{word}{_ANY_GAP}(?:{'|'.join(after)})" for word, after in fixed.STATE_COMPLEMENTS.items())
    verbal = f"(?!(?:{'|'.join(fixed.STATE_ADJECTIVES)}|{states}){_STOP}){participle}"
    results = f"(?!(?:{'|'.join(fixed.GET_RESULTS)}){_STOP})"
    reach = f"{between}{{0,{fixed.FINITE_REACH - 1}}}"
    core = f"(?:(?:{be}){_STOP}{reach} {verbal}|(?:{get}){_STOP}{reach} {results}{verbal})"
    # after "there" a participle followed by anything but "by" belongs to what exists
    there = f"(?<={_START}there{_ANY_GAP})|(?<={_START}there{_ANY_GAP}[a-z']{{1,64}}{_ANY_GAP})"
    followed = rf"(?:{_ANY_GAP}by{_STOP}|(?: [.;:!?])?(?: \x{{FDD2}}|\z))"
    finite = f"{_START}(?=({be}|{get}){_STOP})(?:(?!{there}){core}|{core}(?={followed}))"
    skipped = f"(?!(?:{'|'.join(fixed.AS_BY_EXCLUDED)}){_STOP})" if version >= 5 else ""
    phrase = f"{_START}as{_ANY_GAP}{skipped}{participle}{between}{{0,{fixed.AS_BY_REACH - 1}}} by{_STOP}"
    return finite, phrase


def passive_count(of_canonical: Column, version: int) -> Column:
    """Number of passive sentences in a canonical text."""
    finite, phrase = _patterns(version)
    return count_of(of_canonical, rf"(?:{finite}|{phrase})[^\x{{FDD2}}]*")


def is_passive(sentence: Column, version: int = 5) -> Column:
    finite, phrase = _patterns(version)
    return canonical(sentence).rlike(f"{finite}|{phrase}")


def passive_rule(sentence: Column, version: int = 5) -> Column:
    """Name of the rule that makes a sentence passive."""
    finite, phrase = _patterns(version)
    text = canonical(sentence)
    be, get, as_by, none = fixed.PASSIVE_RULES
    return (
        F.when(text.rlike(finite), F.when(F.regexp_extract(text, finite, 1).isin(*fixed.GET_FORMS), get).otherwise(be))
        .when(text.rlike(phrase), as_by)
        .when(text.isNotNull(), none)
    )


def classify(sentence: Column, version: int = 5) -> Column:
    """Struct ``is_passive``, ``rule``."""
    return F.struct(is_passive(sentence, version).alias("is_passive"), passive_rule(sentence, version).alias("rule"))


def end_sentences(sentences: Column) -> Column:
    """One marked text of an array of sentences."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(s, F.lit(SENTENCE))), "")
