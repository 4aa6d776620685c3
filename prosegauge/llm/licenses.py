"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by path.

1. A file's candidate passages are its lines, its pairs and triples of neighbouring
   lines, and, wherever lines break, runs of as many words as a template has, over
   the whole text: around every word that counts for a notice, and for templates of
   ``LONG`` words or more in steps of a tenth of their length, word by word around the
   best.  Words at the ends of a run that no template has are left out (they only
   lower the cosine).  A passage is a bag of words and word pairs weighted by TF-IDF
   over the templates; the cosine to every template is a sparse product over the
   terms they share.  Templates without a word that the threshold takes, or whose
   terms in the text cannot reach it, are not looked for.
2. A file's own licence is that of its best passage with a cosine of at least
   ``threshold``: a whole licence or header (``LONG``) before a notice, then the
   higher cosine, then the first template by name.
3. A file without one takes the licence of the nearest ancestor directory (its own
   first) that holds a licence file: paths are joined with the directories of
   licence files over all their ancestors, however deep, as equi-joins of distinct
   directories; a directory's files are never gathered, and hot ones stay where they are.

Defined cases: null or empty texts have no own licence but inherit; a null
path has no directory and inherits nothing; repeated rows are judged one by one;
several licence files in one directory: the highest cosine, then the first name;
files without any licence have null; an empty table gives an empty table;
further columns are carried through unless they bear a name of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from prosegauge.llm.batches import parts
from prosegauge.llm.joins import join_counted
from prosegauge.llm.license_templates import TEMPLATES
from prosegauge.runtime import cut

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"
RESULT = ("own_license", "own_cosine", "license", "license_from")
LONG = 64


def terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    """Cosine of passages to the templates by their shared terms."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold, self.least = threshold, threshold**2 * (1 - 1e-9)
        flat = [(name, words_of(t)) for name in sorted(templates) for t in templates[name]]
        bags = [terms(words) for _, words in flat]
        n = len(flat)
        seen = Counter(t for bag in bags for t in bag)
        self.idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in seen.items()}
        self.rare = math.log(1 + n) + 1  # of a term that no template has
        self.names = [name for name, _ in flat]
        self.sizes = [len(words) for _, words in flat]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.squares: list[dict[str, float]] = [{} for _ in flat]
        self.ends: list[list[tuple[str, str, float]]] = [[] for _ in flat]  # first and last word of each term
        for k, bag in enumerate(bags):
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in bag.items()))
            for t, c in bag.items():
                w = c * self.idf[t] / norm
                self.postings.setdefault(t, []).append((k, w))
                self.squares[k][t] = w * w
                self.ends[k].append((t.split(" ")[0], t.split(" ")[-1], w * w))
        self.words = {word for t in self.postings for word in t.split(" ")}
        self.around: dict[str, list[int]] = {}  # the templates a key is for
        for k in range(n):
            for key in self._keys(k):
                self.around.setdefault(key, []).append(k)

    def _keys(self, k: int) -> set[str]:
        """Words of which every passage at the threshold of a template holds at least one.

        A term is looked for by its longest word.  The terms with the shortest and most
        common such words are put aside while their norm stays below the threshold.  A
        passage that shares none of the others has a smaller cosine than that norm.
        """
        keyed = []
        for t, w in self.squares[k].items():
            key = max(t.split(" "), key=lambda word: (len(word), word))
            keyed.append((len(key) > 4, self.idf[key], key, w))
        found, aside = set(), 0.0
        for _, _, key, w in sorted(keyed):
            aside += w
            if aside >= self.least:
                found.add(key)
        return found

    def cosine(self, passage: list[str]) -> tuple[bool, float, int | None]:
        """Whether a long template is reached, the cosine and the number of the best."""
        bag = terms(passage)
        dots: dict[int, float] = {}
        for t, c in bag.items():
            for k, w in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + c * self.idf[t] * w
        if not dots:
            return False, 0.0, None
        norm = math.sqrt(sum((c * self.idf.get(t, self.rare)) ** 2 for t, c in bag.items()))
        best = max(dots, key=lambda k: (*self._rank(k, dots[k] / norm), -k))
        return *self._rank(best, dots[best] / norm), best

    def _rank(self, k: int, cosine: float) -> tuple[bool, float]:
        return self.sizes[k] >= LONG and cosine >= self.threshold, round(cosine, 12)

    def scan(self, text: str | None) -> tuple[str | None, float | None]:
        """Licence and cosine of the best passage of a whole text."""
        words = words_of(text or "")
        every = set(words)
        keys = every & self.around.keys()
        # only templates whose terms in the text could make a cosine at the threshold
        live = {
            m
            for m in {m for key in keys for m in self.around[key]}
            if sum(w for a, b, w in self.ends[m] if a in every and b in every) >= self.least
        }
        if not live:
            return None, None
        keys = {key for key in keys if not live.isdisjoint(self.around[key])}
        best: tuple[bool, float, int | None] = (False, 0.0, None)

        def look(passage: list[str]) -> None:
            nonlocal best
            found = self.cosine(passage)
            if found[2] is not None and (found[:2] > best[:2] or (found[:2] == best[:2] and found[2] < best[2])):
                best = found

        lines = [line for line in map(words_of, text.split("\n")) if line]
        hit = [not keys.isdisjoint(line) for line in lines]
        for k in range(len(lines)):
            for size in (1, 2, 3):
                if k + size <= len(lines) and any(hit[k : k + size]):
                    look(sum(lines[k : k + size], []))
        ends, begins = self._trimmed(words)
        for i, j in self.runs(words, live):
            look(words[begins[i] : ends[j]])
        for m in sorted(live):
            if self.sizes[m] >= LONG:
                found = self.long_run(words, m)
                if found:
                    look(words[begins[found[0]] : ends[found[1]]])
        return (self.names[best[2]], best[1]) if best[2] is not None and best[1] >= self.threshold else (None, None)

    def _trimmed(self, words: list[str]) -> tuple[list[int], list[int]]:
        """For each place the nearest before and beyond it at which a template's word is."""
        n = len(words)
        ends, begins = list(range(n + 1)), list(range(n + 1))
        for k in range(n):
            if words[k] not in self.words:
                ends[k + 1] = ends[k]
        for k in range(n - 1, -1, -1):
            if words[k] not in self.words:
                begins[k] = begins[k + 1]
        return ends, begins

    def runs(self, words: list[str], live: set[int]) -> list[tuple[int, int]]:
        """Runs of words around each key, as many as a notice has that it is for, where
        the terms about it could reach the threshold."""
        n = len(words)
        spans = set()
        for k, word in enumerate(words):
            for m in self.around.get(word, ()):
                size = self.sizes[m]
                if m in live and size < LONG and self.near(words[max(0, k - size + 1) : k + size], m):
                    spans |= {(max(0, s), min(n, s + size)) for s in range(k - size + 1, k + 1)}
        return sorted(spans)

    def long_run(self, words: list[str], m: int) -> tuple[int, int] | None:
        """The run of a long template's size that is nearest to it."""
        n, size = len(words), self.sizes[m]
        step = max(1, size // 10)
        inside = [m in self.around.get(word, ()) for word in words]

        def nearness(s: int) -> float:
            passage = words[max(0, s) : s + size]
            bag = terms(passage)
            dot = sum(c * self.idf[t] * math.sqrt(self.squares[m][t]) for t, c in bag.items() if t in self.squares[m])
            return dot / math.sqrt(sum((c * self.idf.get(t, self.rare)) ** 2 for t, c in bag.items()))

        starts = [s for s in range(0, max(1, n - size + 1) + step - 1, step) if any(inside[s : s + size])]
        if not starts:
            return None
        coarse = max(starts, key=lambda s: (nearness(s), -s))
        fine = max(range(max(0, coarse - step), min(n, coarse + step + 1)), key=lambda s: (nearness(s) if words[s : s + size] else 0.0, -s))
        return fine, min(n, fine + size)

    def near(self, words: list[str], m: int) -> bool:
        """Whether a passage of the words could be at the template's threshold: no
        cosine exceeds the norm of the terms shared."""
        found = set(words) | set(map(" ".join, zip(words, words[1:])))
        return sum(w for t, w in self.squares[m].items() if t in found) >= self.least


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan_licenses(
    files: DataFrame,
    *,
    path_col: str = "path",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = 0.7,
) -> DataFrame:
    """``files`` with ``own_license``, ``own_cosine``, ``license`` and
    ``license_from`` (``file`` or the directory it is inherited from)."""
    kept = [c for c in files.columns if c not in RESULT]
    source = files.select(*kept)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in parts(batches):
            found = [scanner.scan(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*kept, "own_license", "own_cosine"],
            )

    schema = StructType(list(source.schema.fields)).add("own_license", StringType()).add("own_cosine", DoubleType())
    path = F.col(path_col)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    # only licence files are scanned for this side
    granted = (
        source.where(name.rlike(LICENCE_FILE))
        .mapInArrow(run, schema)
        .where("own_license is not null")
        .groupBy(directory(path).alias("_dir"))
        .agg(F.max_by("own_license", F.struct("own_cosine", F.col("own_license"))).alias("_granted"))
    )
    dirs = cut(source.select(directory(path).alias("_leaf")).where("_leaf is not null").groupBy("_leaf").count())
    steps = F.split("_leaf", "/")
    ancestors = dirs.select(
        "_leaf",
        "count",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
        ).alias("_dir"),
    ).distinct()
    nearest = cut(
        ancestors.join(granted, "_dir")
        .groupBy("_leaf", "count")
        .agg(F.max_by(F.struct(F.col("_granted").alias("license"), F.col("_dir").alias("dir")), F.length("_dir")).alias("_near"))
    )
    scanned = source.mapInArrow(run, schema).withColumn("_leaf", directory(path))
    total = dirs.agg(F.sum("count").alias("n")).first()["n"] or 0
    joined = join_counted(scanned, nearest, ["_leaf"], total=total, how="left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        *kept,
        "own_license",
        "own_cosine",
        F.coalesce("own_license", F.col("_near.license")).alias("license"),
        F.when(own, F.lit("file")).otherwise(F.col("_near.dir")).alias("license_from"),
    )
