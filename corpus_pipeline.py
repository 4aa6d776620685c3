"""Corpus pipeline: five stages from raw documents to a mixed training set.

``STAGES`` lists ``(name, function)``; every function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All stages but the last return the columns of
``documents``.  ``run`` applies them to the ``documents`` of a data folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import decontamination, line_dedup, mixing, quality, similar
from prosegauge.llm.joins import only
from prosegauge.runtime import ensure_checkpoint_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model, name="_score").where("_score >= 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they occur first, so
    boilerplate goes and no text is lost altogether."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1, keep_first=True)
    changed = F.col("n_dropped") > 0
    return found.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more (sets of
    five-word shingles) the one with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    groups = similar.similar_documents(docs, width=5, similarity=0.8)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return only(docs, gone, "doc_id", keep=False).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, however long they are: a passage
    in a long document leaks as much as in a short one.  Items of fewer words than a
    window may be common words, so for these a document goes by its share of hits."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.contamination(docs.select(*COLUMNS), items)
    return found.where("not (n_full > 0 or contaminated)").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``,
    ``target`` and ``taken`` (words, repeats counted)."""
    return mixing.mix(docs.select(*COLUMNS), weights=(5.0, 2.0, 1.0), share=1.0, max_repeats=3).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Learned scores and similarities are beyond SQL; the stages are tested against
#: brute force in tests/llm.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they hand on is kept in the shared checkpoint folder, and
    removed when the next one has written its own (the last stage's result still
    reads the last of them)."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, kept = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if kept:
                _remove(spark, kept)
            kept = f"{folder}/{k}-{name}"
    return docs
