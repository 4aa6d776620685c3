"""Which segments count for which metric, as a profile says.

The rules of a profile are data: one row for each metric and role (72 rows a
profile), joined by broadcast, or the same as literals on the array path.

Defined cases: an override on a segment wins over its role; documents without
segments have empty summaries on the array path and no rows on the exploded one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.sources.profiles import Profile

RULES = "profile_ref string, metric_id string, role string, included boolean, unknown_role_policy string"


def rules_frame(spark: SparkSession, profiles: Iterable[Profile]) -> DataFrame:
    """One row for each profile, metric and role: 72 a profile."""
    rows = [
        (p.reference, metric, role, role in p.rules[metric].include, p.rules[metric].unknown_policy)
        for p in profiles
        for metric in fixed.METRICS
        for role in fixed.ROLES
    ]
    return spark.createDataFrame(rows, RULES)


def selected(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Segment rows times metrics, with ``selected``."""
    override = F.col("inclusion_override") if "inclusion_override" in segments.columns else F.lit(None).cast("boolean")
    return segments.join(F.broadcast(rules), "role").withColumn("selected", F.coalesce(override, F.col("included")))


def selection_summary(segments: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """Per document and metric: selected and other segments, and whether the
    metric cannot be given."""
    rows = selected(segments, rules)
    unknown = F.bool_or(F.col("role") == "unknown")
    return rows.groupBy(*(keys or ("doc_id",)), "profile_ref", "metric_id", "unknown_role_policy").agg(
        F.count_if("selected").alias("included_segment_count"),
        F.count_if(~F.col("selected")).alias("excluded_segment_count"),
        (unknown & (F.first("unknown_role_policy") == "unable_to_calculate")).alias("unable"),
    )


def role_counts(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*(keys or ("doc_id",)), "role").agg(F.count("*").alias("segments"))


def coverage(segments: DataFrame, *keys: str) -> DataFrame:
    """Per document: segments, those of unknown role, and the share of the others."""
    n, unknown = F.count("*"), F.count_if(F.col("role") == "unknown")
    return segments.groupBy(*(keys or ("doc_id",))).agg(
        n.alias("segments_total"), unknown.alias("unknown_role_count"), F.try_divide(n - unknown, n).alias("classification_coverage")
    )


def joined_text(rows: DataFrame, *keys: str) -> DataFrame:
    """Text of selected segments in reading order: pages are set off by a blank line."""
    by_order = lambda a, b: a["reading_order"] - b["reading_order"]
    rows = rows.where("selected").groupBy(*(keys or ("doc_id",)), "metric_id").agg(
        F.array_sort(F.collect_list(F.struct("reading_order", "text", "boundary_before")), by_order).alias("s")
    )
    return rows.select(*(keys or ("doc_id",)), "metric_id", text_of(F.col("s")).alias("text"))


def text_of(segments: Column) -> Column:
    parts = F.transform(
        segments,
        lambda s, k: F.concat(F.when(k == 0, "").when(s["boundary_before"] == "page", "\n\n").otherwise("\n"), s["text"]),
    )
    return F.array_join(parts, "")


def selected_array(segments: Column, roles: Iterable[str]) -> Column:
    """The same choice on an array of segments."""
    roles = tuple(roles)
    return F.filter(segments, lambda s: F.coalesce(s["inclusion_override"], s["role"].isin(*roles)))


def others_array(segments: Column, roles: Iterable[str]) -> Column:
    roles = tuple(roles)
    return F.filter(segments, lambda s: ~F.coalesce(s["inclusion_override"], s["role"].isin(*roles)))


def role_count_map(segments: Column) -> Column:
    """Map from role to number of segments, for roles that occur."""

    def entry(role: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.size(F.filter(segments, lambda s: s["role"] == role)).cast("bigint").alias("n"))

    return F.map_from_entries(F.filter(F.array(*map(entry, fixed.ROLES)), lambda c: c["n"] > 0))


def unknown_documents(segments: DataFrame) -> DataFrame:
    """Segment rows with whether their document has any of unknown role."""
    return segments.withColumn("has_unknown", F.max(F.col("role") == "unknown").over(Window.partitionBy("doc_id")))
