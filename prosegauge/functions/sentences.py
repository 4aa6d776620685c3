"""Sentences of blocks.

``marked`` takes a text of one or more blocks (each ended by ``BLOCK`` or the
text's end) and puts ``SENTENCE`` after every sentence.  What is left between the
last sentence of a block and the block's end is a fragment.  Everything else is
counting and splitting at those marks, so a document with many blocks takes as
many passes as one with a single block.

Dots that end no sentence are hidden during the search: between digits, in
listed abbreviations (which also get their listed case), in web and mail
addresses and in runs such as ``U.S.``; but not at a block's very end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import BLOCK, SENTENCE, UNITS, count_of, in_class, let, literal, one_of, strip

_HIDDEN, _MARK = "\ue000", "\ufdd3"
_W = f"[{fixed.WORD_CHARS}]"
_WITH_DOTS = (
    rf"(?:https?://|www\.)[^{fixed.WS}{UNITS}]+"
    rf"|(?:(?<!{_W})(?={_W})|(?<={_W})(?=[.+\-]))[{fixed.WORD_CHARS}.+\-]+@[{fixed.WORD_CHARS}.\-]+\.{_W}+(?!{_W})"
    rf"|(?<!{_W})(?:[A-Za-z]\.){{2,}}"
)
_CLOSERS = f"[{in_class(fixed.SENTENCE_CLOSERS)}]*"
_LAST_PIECE = rf"(?=\x{{FDD1}}|\z)"


def _unmarked(text: Column) -> Column:
    """Without the two marks; replacing strings is much faster than translating characters."""
    return F.replace(F.replace(text, F.lit(BLOCK), F.lit("")), F.lit(SENTENCE), F.lit(""))


def blocks_of(texts: Column) -> Column:
    """One text of an array of block texts."""
    clean = F.transform(texts, lambda t: strip(_unmarked(t)))
    return F.array_join(clean, BLOCK)


def _joined_lines(clean: Column) -> Column:
    return F.array_join(F.transform(F.split(clean, "\n"), lambda t: strip(t)), BLOCK)


def all_line_blocks(text: Column) -> Column:
    """One text whose blocks are the lines of ``text``, in their places (blank ones are empty)."""
    return _joined_lines(_unmarked(text))


def line_blocks(text: Column) -> Column:
    """One text whose blocks are the lines of ``text`` (blank ones stay empty)."""
    # blank lines at a place where several stand are one mark
    return F.regexp_replace(_joined_lines(strip(_unmarked(text))), rf"{BLOCK}{{2,}}", BLOCK)


def protected(text: Column) -> Column:
    # all end with a dot, so the search stops at dots only
    any_listed = rf"(?iu)\.(?<=(?<!{_W}){one_of(fixed.SENTENCE_ABBREVIATIONS)})(?!{_W})"

    def listed(x: Column) -> Column:
        out = x
        for word in fixed.SENTENCE_ABBREVIATIONS:
            out = F.regexp_replace(out, rf"(?iu)(?<!{_W}){literal(word)}(?!{_W})", word.replace(".", _HIDDEN))
        return F.when(x.rlike(any_listed), out).otherwise(x)

    def addresses(x: Column) -> Column:
        pieces = F.split(F.regexp_replace(x, f"({_WITH_DOTS})", f"{_MARK}$1{_MARK}"), _MARK)
        hidden = F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 1, F.translate(p, ".", _HIDDEN)).otherwise(p)), "")
        # each search is for one fixed string, or stops at dots only
        any_of = x.contains("://") | x.contains("www.") | x.contains("@") | x.rlike(r"\.(?<=[A-Za-z]\.)(?=[A-Za-z]\.)")
        return F.when(any_of, hidden).otherwise(x)

    # the longer ways are only taken by texts that need them
    x = let(let(F.regexp_replace(text, r"\.(?<=\p{Nd}\.)(?=\p{Nd})", _HIDDEN), listed), addresses)
    return F.regexp_replace(x, rf"{_HIDDEN}(?={_CLOSERS}(?:\x{{FDD1}}|\z))", ".")


def marked(blocks: Column) -> Column:
    """The text with ``SENTENCE`` after every sentence; abbreviations in their listed case."""
    ends = rf"([.!?]+{_CLOSERS})(?=[{fixed.WS}\x{{FDD1}}]|\z)"
    return F.replace(F.regexp_replace(protected(blocks), ends, f"$1{SENTENCE}"), F.lit(_HIDDEN), F.lit("."))


def only_sentences(of_marked: Column) -> Column:
    """The same without fragments."""
    return F.regexp_replace(of_marked, rf"(?<![^{UNITS}])[^{UNITS}]++{_LAST_PIECE}", "")


def sentence_count(of_marked: Column) -> Column:
    return F.length(of_marked) - F.length(F.replace(of_marked, F.lit(SENTENCE)))


def paragraph_count(of_marked: Column) -> Column:
    """Blocks with at least one sentence."""
    return count_of(of_marked, r"\x{FDD2}[^\x{FDD1}]*")


def fragment_count(of_marked: Column) -> Column:
    return count_of(of_marked, rf"(?<![^{UNITS}])[{fixed.WS}]*+[^{UNITS}]++{_LAST_PIECE}")


def sentence_array(of_marked: Column) -> Column:
    """Array of the sentences of all blocks."""
    # cut at the marks: a pattern for what stands before one would run to the end of a fragment from each of its places
    pieces = F.split(F.replace(only_sentences(of_marked), F.lit(BLOCK), F.lit("")), SENTENCE)
    return F.transform(F.filter(pieces, lambda s: s != ""), lambda s: strip(s))


def sentences(block: Column) -> Column:
    """Array of the sentences of one block."""
    return sentence_array(marked(strip(block)))


def fragment(marked_block: Column) -> Column:
    """What follows the last sentence of one block."""
    return strip(F.element_at(F.split(marked_block, SENTENCE), -1))


def fragments(block: Column) -> Column:
    """Array of the fragment of one block, or empty."""
    last = fragment(marked(strip(block)))
    return F.when(last == "", F.array().cast("array<string>")).when(last.isNotNull(), F.array(last))
