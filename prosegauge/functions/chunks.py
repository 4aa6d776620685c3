"""The counts of ``tokens`` and ``sentences`` for whole batches of texts.

Everything but the passive rule depends on a chunk (what stands between white
space) and on whether it closes its unit or stands before a capital.  So each
distinct chunk is judged once a worker, and a text costs a split and a sum over
looked-up numbers.  The judging follows ``tokens.TOKEN`` and
``tokens.token_syllables`` step by step, and the tests hold both to the same counts.

The chunks known are bounded (``MOST_KNOWN``, none longer than ``LONGEST_KNOWN``);
others are judged anew.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import BLOCK, SENTENCE

MOST_KNOWN, LONGEST_KNOWN = 1 << 19, 64
#: Rows and characters that a worker holds as Python strings at a time.
ROWS, CHARS = 256, 1 << 22

_BITS = 40
_FIELD = (1 << _BITS) - 1
_CHARS, _SYLLABLES, _DIFFERS, _AUXILIARY, _PARTICIPLE = (k * _BITS for k in range(1, 6))

_DELIMITERS = re.compile(f"[{re.escape(fixed.TOKEN_DELIMITERS)}]")
_DOTTED = re.compile(r"\d+(?:\.\d+)*\.")
_CLOSING = re.compile(f"[{re.escape(fixed.TRAILERS)}]*+(?:[.!?][{re.escape(fixed.CLOSERS)}]*+)?\\Z")
_NUMERIC = re.compile(fixed.NUMERIC.replace(r"\p{Nd}", r"\d"))
_V1_WORD = re.compile(fixed.V1_WORD)
_ASCII_WORD = re.compile("[A-Za-z]+(?:['-][A-Za-z]+)*")
_MASKED_WORD = re.compile("L+(?:JL+)*")
#: Leaves the groups of vowels, set off by spaces.
_VOWELS = str.maketrans("bcdfghjklmnpqrstvwxz", " " * 20)
#: What stands before a silent ending is none of these.
_SOUNDED = {"e": "ly", "es": "aeo", "ed": "td"}
_CANONICAL_WORD = re.compile("[a-z]+(?:'[a-z]+)?")
_NOT_LETTERS = re.compile("[^a-z]+")
_ABBREVIATIONS = frozenset(fixed.TOKEN_ABBREVIATIONS)
_BEFORE = frozenset((*fixed.BE_FORMS, *fixed.CONTRACTED_BE, *fixed.GET_FORMS, "as"))
_PARTICIPLES = frozenset(fixed.IRREGULAR_PARTICIPLES)


def _folded_syllables(letters: str) -> int:
    """``tokens.word_syllables``."""
    if len(letters) <= 3:
        return min(1, len(letters))
    groups = len(letters.translate(_VOWELS).split())
    if groups > 1:
        ending = "e" if letters[-1] == "e" else letters[-2:]
        if ending in _SOUNDED and letters[-1 - len(ending)] not in _SOUNDED[ending]:
            return groups - 1
    return max(1, groups)


def _word_syllables(word: str) -> int:
    known = fixed.SYLLABLE_EXCEPTIONS.get(word.casefold())
    if known is not None:
        return known
    plain = word if word.isascii() else unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode()
    return _folded_syllables(plain.lower() if plain.isalpha() else _NOT_LETTERS.sub("", plain.lower()))


def _words(core: str) -> list[str]:
    """``tokens.UNICODE_WORD``."""
    if core.isascii():
        return _ASCII_WORD.findall(core)
    kind = lambda c: "L" if c.isalpha() or unicodedata.category(c) in ("Nl", "No") else "J" if c in "'’-" else " "
    return [core[m.start() : m.end()] for m in _MASKED_WORD.finditer("".join(map(kind, core)))]


def token_syllables(token: str) -> int:
    core = token.strip(fixed.SYLLABLE_STRIPPED)
    if token in fixed.IGNORED_MARKERS or not core:
        return 0
    if core.isalpha():
        return _word_syllables(core)
    if "@" in core:
        return sum(_folded_syllables(_NOT_LETTERS.sub("", w.lower())) for w in _V1_WORD.findall(core))
    if number := _NUMERIC.fullmatch(core):
        digits = sum(c.isdecimal() for c in number[2])
        return max(1, digits + number[2].count(".") + (core.startswith("$") and digits > 1))
    if any(c.isdigit() for c in core) and any(c.isalpha() for c in core):
        return 1
    return sum(map(_word_syllables, _words(core)))


def chunk_tokens(chunk: str, closed: bool) -> list[str]:
    """Tokens of a chunk; ``closed`` says that it is its unit's last or a capital follows."""
    if chunk in fixed.IGNORED_MARKERS:
        return []
    if chunk in _ABBREVIATIONS:
        return [chunk]
    found, parts = [], _DELIMITERS.split(chunk)
    for k, part in enumerate(parts, 1):
        core = part.lstrip(fixed.OPENERS)
        if k < len(parts):
            core = core.rstrip(fixed.TRAILERS)
        elif not _DOTTED.fullmatch(core):
            core = core[: _CLOSING.search(core).start()] if closed else core.rstrip(fixed.TRAILERS)
        if core:
            found.append(core)
    return found


def _packed(tokens: list[str]) -> int:
    return len(tokens) + (sum(map(len, tokens)) << _CHARS) + (sum(map(token_syllables, tokens)) << _SYLLABLES)


def _passive_marks(word: str) -> int:
    """Whether a word of ``passive.canonical`` may begin a passive, or be its participle."""
    return (word in _BEFORE) << _AUXILIARY | (word.endswith("ed") or word in _PARTICIPLES) << _PARTICIPLE


def _all_marks(chunk: str) -> int:
    plain = chunk if chunk.isascii() else chunk.replace("\u212a", "\ufffd").replace("\u0130", "\ufffd").replace("’", "'")
    return sum(map(_passive_marks, _CANONICAL_WORD.findall(plain.lower())))


def _judged(chunk: str) -> tuple[int, int]:
    """Packed counts of a chunk before another and of one that closes."""
    ending = chunk[-1] if chunk[-1] in ",;:.!?" else ""
    core = chunk[: len(chunk) - len(ending)]
    if core.isalpha() and chunk not in _ABBREVIATIONS:
        # letters and one mark, as most chunks are: one token, which keeps its mark where the chunk does not close
        ascii = core.isascii()
        word = core.lower() if ascii else core
        closing = 1 + (len(core) << _CHARS) + (_word_syllables(word) << _SYLLABLES) + (_passive_marks(word) if ascii else _all_marks(core))
        return (closing + (1 << _CHARS) + (1 << _DIFFERS) if ending and ending in ".!?" else closing), closing
    tokens, closed = chunk_tokens(chunk, False), chunk_tokens(chunk, True)
    before = _packed(tokens)
    closing = before if closed == tokens else _packed(closed)
    differs = (before != closing) << _DIFFERS
    marks = _all_marks(chunk)
    return before + marks + differs, closing + marks


class _Known(dict):
    """Packed counts by chunk, made when first asked for."""

    def __init__(self, which: int):
        self.which = which

    def __missing__(self, chunk: str) -> int:
        made = _judged(chunk)
        if len(chunk) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[chunk] = made[self.which]
        return made[self.which]


_before, _closing = _Known(0), _Known(1)


def _unit(text: str) -> int:
    """Packed counts of a unit (a block or sentence)."""
    chunks = text.split()
    if not chunks:
        return 0
    last = chunks.pop()
    total = sum(map(_before.__getitem__, chunks)) + _closing[last]
    if total >> _DIFFERS & _FIELD:
        chunks.append(last)
        for chunk, following in zip(chunks, chunks[1:]):
            if following[0].isupper() and _before[chunk] >> _DIFFERS & _FIELD:
                total += _closing[chunk] - _before[chunk]
    return total


def totals(text: str) -> tuple[int, int, int]:
    """Words, characters and syllables of a text of units."""
    total = sum(map(_unit, text.replace(SENTENCE, BLOCK).split(BLOCK)))
    return total & _FIELD, total >> _CHARS & _FIELD, total >> _SYLLABLES & _FIELD


def counts(marked: str) -> tuple[int, int, int, int, int, int, str]:
    """Of a text with marked sentences: words, sentences, paragraphs, fragments,
    characters, syllables, and those sentences that may be passive."""
    total = sentences = paragraphs = fragments = 0
    passive = []
    for block in marked.split(BLOCK):
        units = block.split(SENTENCE)
        fragments += bool(units.pop().strip())
        paragraphs += bool(units)
        sentences += len(units)
        for unit in units:
            found = _unit(unit)
            total += found
            if found >> _PARTICIPLE and found >> _AUXILIARY & _FIELD:
                passive.append(unit)
    may = SENTENCE.join((*passive, "")) if passive else ""
    return total & _FIELD, sentences, paragraphs, fragments, total >> _CHARS & _FIELD, total >> _SYLLABLES & _FIELD, may


def _texts(values: pa.Array):
    """The values as strings, a bounded part at a time."""
    for k in range(0, len(values), ROWS):
        part = values.slice(k, ROWS)
        large = part.nbytes > CHARS
        yield from (v.as_py() for v in part) if large else part.to_pylist()


COUNTS = ("readability_word_count", "sentence_count", "paragraph_count", "fragment_count", "character_count", "syllable_count")
_TOTALS = [pa.field(name, pa.int64()) for name in ("words", "characters", "syllables")]
_COUNTS = [pa.field(name, pa.int64()) for name in COUNTS] + [pa.field("may_be_passive", pa.string())]


def _structs(f: Callable[[str], tuple], values: pa.Array, fields: list[pa.Field]) -> pa.Array:
    """``f`` of each value; a null has null fields."""
    none = (None,) * len(fields)
    columns = list(zip(*(none if t is None else f(t) for t in _texts(values)))) or none
    return pa.StructArray.from_arrays([pa.array(c or (), x.type) for c, x in zip(columns, fields)], fields=fields)


def _total_batch(values: pa.Array) -> pa.Array:
    return _structs(totals, values, _TOTALS)


def _count_batch(values: pa.Array) -> pa.Array:
    return _structs(counts, values, _COUNTS)


def _of_batches(column: Column, f: Callable[[pa.Array], pa.Array], fields: list[pa.Field]) -> Column:
    # ``f`` is of this module, so workers find it with the chunks it knows
    def batch(values: pa.Array) -> pa.Array:
        return f(values)

    batch.__annotations__ = {"values": pa.Array, "return": pa.Array}
    kind = ",".join(f"{x.name}:{'bigint' if x.type == pa.int64() else 'string'}" for x in fields)
    return F.arrow_udf(batch, f"struct<{kind}>")(column)


def count_struct(marked: Column) -> Column:
    """Struct of ``COUNTS`` and ``may_be_passive`` (sentences with their marks) of marked texts."""
    return _of_batches(marked, _count_batch, _COUNTS)


def total_struct(text: Column) -> Column:
    """Struct ``words``, ``characters``, ``syllables`` of the tokens of texts."""
    return _of_batches(text, _total_batch, _TOTALS)
