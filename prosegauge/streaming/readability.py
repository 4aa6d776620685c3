"""Readability of documents as they arrive.

All text functions are expressions of one row, so the measurement is an append
stream without state or watermark.  ``running_totals`` adds what needs state:
summed counts by a key, from which ratios are taken once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosegauge.operators import measure


def read_documents(spark: SparkSession, folder: str, schema, *, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def document_metrics(stream: DataFrame, *, version: int = 5) -> DataFrame:
    """One row of counts and metrics for each document, in append mode."""
    return measure.line_readability(stream, version=version)


def running_totals(stream: DataFrame, *keys: str, version: int = 5) -> DataFrame:
    """Totals and ratios by key so far, in complete or update mode; state is one row a key."""
    return measure.readability_by(measure.line_readability(stream, version=version), *keys)


def windowed_totals(stream: DataFrame, time: str, *, window: str, delay: str, version: int = 5) -> DataFrame:
    """Totals and ratios by time window; windows close ``delay`` after their end."""
    late = measure.line_readability(stream.withWatermark(time, delay), version=version)
    return measure.readability_by(late.withColumn("window", F.window(time, window)), "window")


def run_to_end(result: DataFrame, table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what there is, into an in-memory table."""
    query = result.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
