"""Session-level helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Name of the shared checkpoint folder.

    The cluster's ``spark.checkpoint.dir`` wins, then ``SparkContext.setCheckpointDir``.
    Only a local session (tests) that names none gets a temporary one; on a cluster
    executors and driver would not see each other's.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prosegauge-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once, kept in the shared
    folder and survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def made_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and new columns that are values from here on: the optimizer would put an
    expression wherever it is read, in a lambda once an element."""
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")).select(*keep, "_made.*")


#: Tables of texts, whose rows are worth spreading.
TEXT_TABLES = ("documents", "pages", "conversations")


#: Tables of fewer splits are spread; larger ones are exchanged for no such reason.
FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its few files make fewer partitions than there are cores
    (one small file is one task, however many cores wait)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(found) if name in TEXT_TABLES else found
