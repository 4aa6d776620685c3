"""Predicates on single lines of a page.  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import casefold, count_of, in_class, strip

_CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def normalized(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    # a single space, as most runs are, stays without being replaced by itself; one range rules out most other characters
    return strip(F.regexp_replace(text, f" (?![!-~])[{fixed.WS}]++|(?![ -~])[{fixed.WS}]++", " "))


def edge_key(text: Column) -> Column:
    """What repeated page edges have in common: case and numbers do not matter."""
    return F.regexp_replace(casefold(normalized(text)), r"\p{Nd}+", "#")


def is_upper(text: Column) -> Column:
    """Some cased character, and none in lower or title case."""
    return text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Capitals begin every run of cased characters and stand nowhere else."""
    return text.rlike(_CASED) & ~text.rlike(rf"{_CASED}[\p{{IsUppercase}}\p{{Lt}}]|(?<!{_CASED})\p{{IsLowercase}}")


def is_page_number(text: Column) -> Column:
    ws = f"[{fixed.WS}]"
    # only what ends with a digit is folded, as folding makes no digits
    return text.rlike(r"\p{Nd}\z") & casefold(text).rlike(rf"^(?:page{ws}+)?\p{{Nd}}+(?:{ws}+of{ws}+\p{{Nd}}+)?\z")


def is_contents_line(text: Column) -> Column:
    return text.rlike(rf"\.{{3,}}[{fixed.WS}]*\p{{Nd}}+[{fixed.WS}]*\z")


def is_list_line(text: Column) -> Column:
    marks = in_class(fixed.LINE_LIST_MARKS)
    return text.rlike(rf"^[{fixed.WS}]*(?:[{marks}]|o|\(?\p{{Nd}}{{1,3}}[.)])[{fixed.WS}]+")


def is_heading_shape(text: Column) -> Column:
    words = count_of(text, "[A-Za-z]+")
    return (
        # the length first, so that long lines are not cut to words
        (F.length(text) <= fixed.HEADING_MAX_CHARS)
        & words.between(1, fixed.HEADING_MAX_WORDS)
        & ~text.rlike(r"[.?!;:]\z")
        & (is_title(text) | is_upper(text))
    )
