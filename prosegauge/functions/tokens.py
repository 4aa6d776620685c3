"""Words of a text, their characters and syllables.

A text may hold several units (blocks, sentences) that end with ``BLOCK`` or
``SENTENCE``; what follows a unit's end is not seen from inside it.

One pattern finds the tokens of a whole text, and a second one counts its
syllables; no array is built for each chunk.  Null texts give null, empty texts
no tokens.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import UNITS, all_of, casefold, count_of, digit_class, fold, in_class, let, one_of, strip

_INSIDE = rf"[^{fixed.WS}{UNITS}]"
_EDGE = rf"{fixed.WS}{UNITS}{in_class(fixed.TOKEN_DELIMITERS)}"
_PART = rf"[^{_EDGE}]"
_TRAIL = f"[{in_class(fixed.TRAILERS)}]*"
_MARKER = f"[{in_class(''.join(fixed.IGNORED_MARKERS))}]"
#: The chunk is its unit's last, or the next one begins with a capital.
_CLOSED = rf"(?:[{fixed.WS}]*(?:[{UNITS}]|\z)|[{fixed.WS}]+\p{{IsUppercase}})"
#: Nothing but trailers follows in the part; at the end of a closed chunk also one mark, and closers.
_OVER = rf"{_TRAIL}(?:(?:[.!?][{in_class(fixed.CLOSERS)}]*)?{_CLOSED}|[{_EDGE}]|\z)"
_ENDINGS = in_class(fixed.TRAILERS + ".!?")
TOKEN = (
    # markers, outside the group
    rf"{_MARKER}(?<!{_INSIDE}{_MARKER})(?!{_INSIDE})"
    rf"|(?=[A-Za-z]|{_PART})[{in_class(fixed.OPENERS)}]*+("
    # abbreviations and numbers with a dot, whole
    rf"(?=[A-Za-z]{{1,3}}\.){one_of(fixed.TOKEN_ABBREVIATIONS)}(?!{_INSIDE})(?<!{_INSIDE}{one_of(fixed.TOKEN_ABBREVIATIONS)})"
    rf"|\p{{Nd}}+(?:\.\p{{Nd}}+)*\.(?!{_INSIDE})"
    # letters run through; only where a trailer or mark stands, its end is looked for
    rf"|(?:[A-Za-z]++|[^{_EDGE}{_ENDINGS}]|(?=[{_ENDINGS}])(?!{_OVER})[{_ENDINGS}])*+"
    rf"){_PART}*+"
)

_VOWEL, _CONSONANT = "[aeiouy]", "[bcdfghjklmnpqrstvwxz]"
#: At a word's last group of vowels: it is silent if another group stands before it.
_SILENT = (
    rf"(?:(?:(?<!l)e|{_VOWEL}*[aeiou]e)(?![a-z])"
    rf"|(?:e|{_VOWEL}*[iuy]e)s(?![a-z])"
    rf"|(?:(?<![td])e|{_VOWEL}+e)d(?![a-z]))"
)
#: Consonants between two groups of vowels, in words of four letters or more, the second not silent.
FURTHER_SYLLABLE = (
    rf"(?={_CONSONANT})(?<={_VOWEL})(?:(?<=[a-z]{_VOWEL}){_CONSONANT}+|(?<=(?<![a-z]){_VOWEL}){_CONSONANT}{{2,}}"
    rf"|(?<=(?<![a-z]){_VOWEL}){_CONSONANT}(?={_VOWEL}[a-z]))(?={_VOWEL})(?!{_SILENT})"
)
_L = f"[{fixed.LETTER_CHARS}]"
_JOINT = "['’-]"
UNICODE_WORD = f"{_L}+(?:{_JOINT}{_L}+)*"


def tokens(text: Column) -> Column:
    """Array of the readability words of a text, in order."""
    return F.filter(all_of(text, TOKEN, 1), lambda t: t != "")


def word_syllables(folded: Column) -> Column:
    """Syllables of one word of letters a to z (others are left out)."""
    value = F.regexp_replace(folded, "[^a-z]", "")
    return (
        F.when(F.length(value) == 0, 0)
        .when(F.length(value) <= 3, 1)
        .otherwise(
            F.greatest(
                F.lit(1),
                count_of(value, f"{_VOWEL}+")
                - F.when(value.rlike("(?:(?<![ly])e|(?<![aeo])es|(?<![td])ed)$") & (count_of(value, f"{_VOWEL}+") > 1), 1).otherwise(0),
            )
        )
    )


def _total(words: Column, count) -> Column:
    return F.aggregate(F.transform(words, count), F.lit(0), lambda total, n: total + n)


def _known_word(word: Column) -> Column:
    """Syllables of a whole word in letters of any script."""
    low, known = casefold(word), F
    for exception, n in fixed.SYLLABLE_EXCEPTIONS.items():
        known = known.when(low == exception, n)
    return known.otherwise(word_syllables(fold(word)))


def _numeric(core: Column) -> Column:
    number = F.regexp_extract(core, f"^{fixed.NUMERIC}$", 2)
    digits = F.length(F.regexp_replace(number, r"[^\p{Nd}]", ""))
    dots = F.length(number) - F.length(F.replace(number, F.lit(".")))
    return F.greatest(F.lit(1), digits + dots + F.when(core.startswith("$") & (digits > 1), 1).otherwise(0))


@cache
def _special() -> str:
    return f"[{digit_class()}@]"


def token_syllables(token: Column) -> Column:
    """Syllables of one token, by its kind."""
    core = strip(token, fixed.SYLLABLE_STRIPPED)
    return (
        F.when(token.isin(*fixed.IGNORED_MARKERS) | (core == ""), 0)
        .when(core.contains("@"), _total(all_of(core, fixed.V1_WORD), lambda w: word_syllables(F.lower(w))))
        .when(core.rlike(f"^{fixed.NUMERIC}$"), _numeric(core))
        .when(core.rlike(f"[{digit_class()}]") & core.rlike(r"\p{L}"), 1)
        .otherwise(_total(all_of(core, UNICODE_WORD), _known_word))
    )


def _estimate(word: str) -> int:
    """What the general rule gives for a listed word (for the difference only)."""
    import unicodedata

    letters = "".join(c for c in unicodedata.normalize("NFKD", word) if c.isascii() and c.isalpha())
    groups = "".join(c if c in "aeiouy" else " " for c in letters).split()
    silent = len(groups) > 1 and (
        (letters.endswith("e") and letters[-2] not in "ly")
        or (letters.endswith("es") and letters[-3] not in "aeo")
        or (letters.endswith("ed") and letters[-3] not in "td")
    )
    return 1 if len(letters) <= 3 else max(1, len(groups) - silent)


def folded_syllables(words: Column) -> Column:
    """Syllables of all words in a text of letters a to z and separators: one a
    word, and one for each further group of vowels that is not silent."""
    return count_of(words, "[a-z]+") + count_of(words, FURTHER_SYLLABLE)


def _difference(word: Column, listed: dict[str, int]) -> Column:
    low, out = casefold(word), F
    for known, n in listed.items():
        out = out.when(low == known, n)
    return out.otherwise(0)


def syllable_total(of_tokens: Column) -> Column:
    """Sum of ``token_syllables``, by patterns over the joined tokens; only tokens
    with digits or ``@`` are looked at one by one."""
    odd_ones = rf"(?<![^ ])(?:[A-Za-z]++|[^ {_special()[1:-1]}])*+{_special()}[^ ]*+"
    listed = {word: n - _estimate(word) for word, n in fixed.SYLLABLE_EXCEPTIONS.items() if n != _estimate(word)}
    words, begins = "|".join(listed), "".join(sorted({word[0] for word in listed}))
    whole = rf"(?iu)(?=[{begins}])(?:{words})(?!{_L})(?!{_JOINT}{_L})(?<!{_L}(?:{words}))(?<!{_L}{_JOINT}(?:{words}))"

    def plain_words(plain: Column) -> Column:
        joined = F.regexp_replace(plain, f"{_JOINT}(?<={_L}{_JOINT})(?={_L})", "")
        known = F.aggregate(all_of(plain, whole), F.lit(0), lambda total, w: total + _difference(w, listed))
        return let(fold(joined), folded_syllables) + known

    def both(every: Column) -> Column:
        odd = _total(all_of(every, odd_ones), token_syllables)
        some = every.rlike(rf"[0-9@]|[^\x00-\x7F](?<={_special()})")
        return F.when(some, let(F.regexp_replace(every, odd_ones, ""), plain_words) + odd).otherwise(plain_words(every))

    return let(F.array_join(of_tokens, " "), both)  # no token holds white space


def char_total(of_tokens: Column) -> Column:
    return F.length(F.array_join(of_tokens, ""))


def token_stream(text: Column) -> Column:
    """Array of structs ``surface``, ``chars``, ``syllables``."""
    return F.transform(
        tokens(text),
        lambda t: F.struct(
            t.alias("surface"), F.length(t).cast("long").alias("chars"), token_syllables(t).cast("long").alias("syllables")
        ),
    )


def syllable_breakdown(text: Column) -> Column:
    """Array of structs ``token``, ``syllables``, ``word_units``, ``reason`` of a
    text's chunks (not of its tokens: web addresses stay whole here)."""

    def item(token: Column, n: Column, units: Column, reason) -> Column:
        return F.struct(
            token.alias("token"), n.cast("long").alias("syllables"), units.cast("long").alias("word_units"), reason.alias("reason")
        )

    def of_chunk(core: Column) -> Column:
        web = core.rlike("^https?://")
        units = F.when(web, F.size(F.filter(F.split(core, "://|/"), lambda p: p != ""))).otherwise(1)
        electronic = _total(all_of(core, fixed.V1_WORD), lambda w: word_syllables(F.lower(w)))
        listed = tuple(fixed.SYLLABLE_EXCEPTIONS)
        words = F.transform(
            all_of(core, UNICODE_WORD),
            lambda w: item(w, _known_word(w), F.lit(1), F.when(casefold(w).isin(*listed), "exception").otherwise("unicode_normalized_v1")),
        )
        return (
            F.when(web | core.contains("@"), F.array(item(core, electronic, units, F.lit("electronic_v1_components"))))
            .when(core.rlike(f"^{fixed.NUMERIC}$"), F.array(item(core, _numeric(core), F.lit(1), F.lit("numeric_pattern"))))
            .when(
                core.rlike(f"[{digit_class()}]") & core.rlike(r"\p{L}"),
                F.array(item(core, F.lit(1), F.lit(1), F.lit("mixed_identifier"))),
            )
            .otherwise(words)
        )

    chunks = F.filter(all_of(text, f"{_INSIDE}+"), lambda c: ~c.isin(*fixed.IGNORED_MARKERS))
    cores = F.filter(F.transform(chunks, lambda c: strip(c, fixed.SYLLABLE_STRIPPED)), lambda c: c != "")
    return F.flatten(F.transform(cores, of_chunk))
