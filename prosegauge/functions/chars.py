"""Character classes, folding and rounding shared by the text functions.

Null in, null out, throughout.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a block and a sentence inside a text that holds several; noncharacters,
#: which no text may hold.
BLOCK, SENTENCE = "\ufdd1", "\ufdd2"
UNITS = r"\x{FDD1}\x{FDD2}"
#: Letters that decompose or fold, and digits, all lie below.
LAST = 0x30000


def in_class(chars: str) -> str:
    """The characters as the inside of a character class."""
    return "".join(rf"\x{{{ord(c):X}}}" for c in chars)


def literal(text: str) -> str:
    """The text as a pattern that matches it alone."""
    return "".join(c if c.isalnum() and c.isascii() else rf"\x{{{ord(c):X}}}" for c in text)


def one_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(literal, words)) + ")"


def strip(text: Column, chars: str = fixed.WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _ranges(chars: list[int]) -> str:
    out, k = [], 0
    while k < len(chars):
        j = k
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(rf"\x{{{chars[k]:X}}}" + (rf"-\x{{{chars[j]:X}}}" if j > k else ""))
        k = j + 1
    return "".join(out)


@cache
def digit_class() -> str:
    """Inside of a class: whatever counts as a digit, superscripts included."""
    odd = [k for k in range(128, LAST) if (c := chr(k)).isdigit() and not c.isdecimal()]
    return r"\p{Nd}" + _ranges(odd)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Non-ASCII letters whose compatibility decomposition holds ASCII letters:
    those with one, what they become, and those with several."""
    one_from, one_to, several = [], [], {}
    for k in range(128, LAST):
        c = chr(k)
        if unicodedata.decomposition(c) and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "No"):
            letters = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalpha()).lower()
            if len(letters) == 1:
                one_from.append(c)
                one_to.append(letters)
            elif letters:
                several[c] = letters
    return "".join(one_from), "".join(one_to), several


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _replace_chars(text: Column, table: dict[str, str]) -> Column:
    """Each character of the table by its string; texts without any are left as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    changed = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(pairs, c), c)), "")
    return F.when(text.rlike(f"[{_ranges(sorted(map(ord, table)))}]"), changed).otherwise(text)


def fold(text: Column) -> Column:
    """Letters as a to z: ASCII in lower case, others as the ASCII letters of
    their decomposition, or gone if they have none.  Other characters stay."""
    one_from, one_to, several = _folds()

    def wide(x: Column) -> Column:
        ascii_ones = let(F.translate(x, UPPER + one_from, LOWER + one_to), lambda y: _replace_chars(y, several))
        return F.regexp_replace(ascii_ones, rf"[[{fixed.LETTER_CHARS}]&&[^\x00-\x7F]]+", "")

    return let(text, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), wide(x)).otherwise(F.lower(x)))


@cache
def _case_folds() -> tuple[str, str, dict[str, str]]:
    one_from, one_to, several = [], [], {}
    for k in range(128, LAST):
        c = chr(k)
        low, folded = c.lower(), c.casefold()
        if folded != low and c == low:
            if len(folded) == 1:
                one_from.append(c)
                one_to.append(folded)
            else:
                several[c] = folded
    return "".join(one_from), "".join(one_to), several


def casefold(text: Column) -> Column:
    """Lower case for comparison: also sharp s, ligatures and the like."""
    one_from, one_to, several = _case_folds()
    wide = lambda x: let(F.translate(x, one_from, one_to), lambda y: _replace_chars(y, several))
    return let(F.lower(text), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), wide(x)).otherwise(x))


def half_even(x: Column, digits: int) -> Column:
    """``x`` rounded to decimals as its exact binary value demands, ties to even.

    The product with a power of ten is taken with its rounding error (the
    factor is split in two halves whose products are exact), so the comparison
    with one half is exact, unlike in ``round`` and ``bround``.
    """
    scale = F.lit(float(10**digits))

    def split(v: Column) -> Column:
        size = F.abs(v)
        shifted = size * F.lit(134217729.0)
        return F.struct(v.alias("v"), size.alias("m"), (shifted - (shifted - size)).alias("high"), (size * scale).alias("p"))

    def nearest(s: Column) -> Column:
        error = (s["high"] * scale - s["p"]) + (s["m"] - s["high"]) * scale
        whole = F.floor(s["p"]).cast("double")
        return F.struct(s["v"].alias("v"), s["m"].alias("m"), whole.alias("whole"), ((s["p"] - (whole + F.lit(0.5))) + error).alias("over"))

    def rounded(s: Column) -> Column:
        up = (s["over"] > 0) | ((s["over"] == 0) & (F.pmod(s["whole"], F.lit(2.0)) == 1.0))
        out = F.when(up, s["whole"] + 1.0).otherwise(s["whole"]) / scale
        return F.when(s["m"] >= 1e13, s["v"]).when(s["v"] < 0, -out).when(s["v"].isNotNull(), out)

    return let(x, lambda v: let(split(v), lambda s: let(nearest(s), rounded)))
