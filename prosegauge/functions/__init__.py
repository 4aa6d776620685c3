"""Column builders: text in, counts, arrays and flags out.

They are built-in expressions through and through, so they run unchanged on batch
and streaming frames and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prosegauge.functions import lines, passive, sentences, tokens, v1
from prosegauge.functions.chars import casefold, fold, half_even

__all__ = ["casefold", "fold", "half_even", "lines", "passive", "sentences", "tokens", "v1"]


#: Builders by the name callers may choose them by.
TEXT_FUNCTIONS = {
    "readability_tokens": tokens.token_stream,
    "syllable_breakdown": tokens.syllable_breakdown,
    "text_sentences": sentences.sentences,
    "text_fragments": sentences.fragments,
    "is_passive": passive.is_passive,
    "passive_rule": passive.passive_rule,
    "v1_sentences": v1.v1_sentences,
}


def select_with(df, column: str, name: str, alias: str | None = None):
    """``df`` with the named function of a column, for callers that choose by name."""
    return df.withColumn(alias or name, TEXT_FUNCTIONS[name](F.col(column)))
