"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of texts in it; a
text belongs to the language whose dictionary makes it smallest.  Texts are
normalised (letters in lower case, everything else one space) and compressed in
pieces, so that what a long text says of itself does not drown the dictionary;
all pieces count.  Where the two smallest sizes are closer than ``min_margin`` (a
share of the second), the text is rejected: the answer is ``und``, or the language
stays and only ``rejected`` is set, as a caller wishes.

Learning: per language at most ``sample_docs`` labelled texts, chosen by a hash of
their id, fill a dictionary of ``dict_bytes``.  A text longer than its share of a
dictionary (``dict_bytes / PARTS``) gives words from all over it, evenly spaced.  All
dictionaries together have ``model_bytes`` at most, so with many languages they are
smaller; this bounds the model, which is broadcast.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; with
no language to learn from everything is ``und``; ties go to the language with the
most labelled texts, then to the first in code point order; texts of any length are read whole, piece by piece; rows
that repeat an id are judged one by one; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.batches import parts
from prosegauge.runtime import cut

UNKNOWN = "und"
PARTS = 16
PIECE = 1536
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip()


def learn(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 400,
    dict_bytes: int = 65536,
    model_bytes: int = 1 << 24,
) -> dict[str, bytes]:
    """Dictionary contents by language, from labelled rows; most frequent first."""
    spot = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), spot.alias("spot"), F.col(text_col).alias("text")
    )
    counts = cut(labelled.groupBy("lang").count())
    dict_bytes = min(dict_bytes, model_bytes // max(1, counts.count()))
    most = max(1, dict_bytes // PARTS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [evenly(normalised(t.as_py()), most) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["lang", "spot", "text"])

    # twice as many as needed can pass; the surplus is left unread below
    sampled = labelled.join(F.broadcast(counts), "lang").where(F.col("spot") * F.col("count") < 2.0 * sample_docs)
    texts = sampled.select("lang", "spot", "text").mapInArrow(spread, "lang string, spot double, text string")
    chosen: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for row in texts.dropDuplicates().orderBy("spot", "lang", "text").toLocalIterator():
        lang, piece = row["lang"], (row["text"] + " ").encode()
        held = chosen.setdefault(lang, [])
        if len(held) < sample_docs and size.get(lang, 0) + len(piece) <= dict_bytes:
            held.append(piece)
            size[lang] = size.get(lang, 0) + len(piece)
    number = {r["lang"]: r["count"] for r in counts.where(F.col("lang").isin([lang for lang in chosen if size.get(lang, 0) >= 8])).collect()}
    return {lang: b"".join(chosen[lang]) for lang in sorted(number, key=lambda lang: (-number[lang], lang))}


def evenly(text: str, most: int) -> str:
    """The text, or as much as fits into ``most`` bytes of passages of 96 characters
    spread evenly over all of it."""
    size = len(text.encode())
    if size <= most:
        return text
    width = 96
    runs = max(1, int(most / (size / len(text)) / (width + 1)))
    step = len(text) / runs
    return " ".join(text[int(k * step) : int(k * step) + width] for k in range(runs)).encode()[:most].decode("utf-8", "ignore")


class Judge:
    def __init__(self, model: dict[str, bytes], level: int = 6):
        self.langs = list(model)
        self.by = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.by.append(
                zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_dict_id=False).compress
            )

    def sizes(self, text: str) -> list[int]:
        data = text.encode()
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return [sum(len(compress(p)) for p in pieces) for compress in self.by]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: what the second size has more, as a share of it."""
        text = normalised(text)
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        others = [n for k, n in enumerate(sizes) if k != best]
        margin = 1 - sizes[best] / min(others) if others else 1.0
        scale = max(4.0, 0.02 * sizes[best])
        return self.langs[best], 1.0 / (1.0 + sum(math.exp((sizes[best] - n) / scale) for n in others)), margin


def identify(
    docs: DataFrame,
    model: dict[str, bytes],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_margin: float = 0.005,
    reject: bool = True,
) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``margin`` and ``rejected`` (narrower
    than ``min_margin``, or no language at all); narrow, no exchange.  Where
    ``reject`` is set, what is rejected is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in parts(batches):
            found = [judge(t.as_py()) for t in batch.column(1)]
            thin = [lang == UNKNOWN or margin < min_margin for lang, _, margin in found]
            names = [UNKNOWN if reject and no else lang for (lang, *_), no in zip(found, thin)]
            scores = [0.0 if name == UNKNOWN else x[1] for name, x in zip(names, found)]
            columns = ((names, pa.string()), (scores, pa.float64()), ([x[2] for x in found], pa.float64()), (thin, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in columns)], names=[id_col, "lang_pred", "score", "margin", "rejected"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, margin double, rejected boolean")
