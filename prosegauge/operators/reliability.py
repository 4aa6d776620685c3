"""How far an estimate can be trusted: the same metric with and without segments
of unknown role, the share of words in them, and pages that could not be read.

All of it is arithmetic on one row a document; both scenarios are counted in the
same pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.functions.chars import half_even, let

METHOD = ("pdf-estimate-reliability", "0.2.0")


def reliability(
    metric: str,
    *,
    included: Column,
    excluded: Column,
    classification_coverage: Column,
    unknown_segments: Column,
    unknown_words: Column,
    total_words: Column,
    failed_pages: Column,
    ceiling: str | None = None,
    more_codes: tuple[str, ...] = (),
) -> Column:
    """Struct with level, evidence, sensitivity and reason codes."""
    if ceiling is not None and ceiling not in fixed.LEVELS:
        raise ValueError(f"unsupported reliability ceiling: {ceiling}")
    k = fixed.METRICS.index(metric)
    high, moderate = F.lit(fixed.HIGH_DELTAS[k]), F.lit(fixed.MODERATE_DELTAS[k])
    share = F.coalesce(F.try_divide(unknown_words, total_words), F.lit(0.0))
    given = F.struct(
        included.cast("double").alias("a"), excluded.cast("double").alias("b"), share.alias("share"), classification_coverage.alias("coverage"),
        unknown_segments.cast("bigint").alias("segments"), unknown_words.cast("bigint").alias("words"), failed_pages.cast("bigint").alias("failed"),
    )

    def with_deltas(g: Column) -> Column:
        a, b = g["a"], g["b"]
        relative = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * F.lit(100.0)
        return F.struct(g.alias("g"), half_even(F.abs(a - b), 4).alias("apart"), half_even(relative, 4).alias("relative"))

    def judged(d: Column) -> Column:
        g, apart, relative = d["g"], d["apart"], d["relative"]
        usable = g["b"].isNotNull()
        delta = apart if metric in fixed.ABSOLUTE_DELTA_METRICS else relative
        low = ~usable | (g["failed"] > 0) | (g["share"] > fixed.MODERATE_SHARE) | (delta > moderate)
        level = F.when(low, 0).when((g["share"] > fixed.HIGH_SHARE) | (delta > high), 1).otherwise(2)
        if ceiling is not None:
            level = F.least(level, F.lit(fixed.LEVELS.index(ceiling)))
        codes = [
            F.when(~usable, "excluded_unknown_scenario_unusable"),
            F.when(g["failed"] > 0, "page_extraction_incomplete"),
            F.when(g["segments"] == 0, "complete_resolved_role_scope")
            .when(g["words"] == 0, "unknown_segments_have_zero_word_units")
            .otherwise("unknown_segments_contain_word_units"),
            F.when(usable & (delta <= high), "unknown_policy_sensitivity_negligible")
            .when(usable & (delta <= moderate), "unknown_policy_sensitivity_moderate")
            .when(usable, "unknown_policy_sensitivity_material"),
            *map(F.lit, more_codes),
        ]
        sensitivity = F.struct(
            g["a"].alias("included_unknown_value"), g["b"].alias("excluded_unknown_value"), apart.alias("absolute_delta"), relative.alias("relative_delta_percent")
        )
        return F.struct(
            F.get(F.array(*map(F.lit, fixed.LEVELS)), level).alias("level"),
            F.struct(F.lit("configured").alias("status"), F.lit(METHOD[0]).alias("id"), F.lit(METHOD[1]).alias("version")).alias("method"),
            g["coverage"].alias("classification_coverage"),
            g["segments"].alias("unknown_segment_count"),
            g["words"].alias("unknown_word_count"),
            half_even(g["share"], 6).alias("unknown_word_share"),
            g["failed"].alias("failed_page_count"),
            sensitivity.alias("sensitivity"),
            F.array_compact(F.array(*codes)).alias("reason_codes"),
        )

    return let(given, lambda g: let(with_deltas(g), judged))
