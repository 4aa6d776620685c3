"""Checks of what adapters hand over, and of results, as data.

Every check is a condition over a row; ``violations`` lists what fails, so one job
checks any number of documents.  ``conformance`` runs an adapter twice over the same
sources and compares.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge import fixed
from prosegauge.errors import AdapterContractError
from prosegauge.plans.registry import Adapter, configuration_sha256
from prosegauge.schema import DOCUMENT_FIELDS, with_document_fields

CHECKS = (
    "descriptor_valid", "source_contract_valid", "support_assessment_valid", "output_contract_valid", "deterministic_output",
    "policy_override_absent", "materialized_path_privacy",
)


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _not_sha256(text: Column) -> Column:
    return ~F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def _document_checks(adapter: Adapter | None) -> dict[str, Column]:
    consumed, used = F.col("artifacts_consumed"), F.col("capabilities_used")
    declared = F.array(*map(F.lit, adapter.capabilities if adapter else fixed.CAPABILITIES))
    names = F.transform("artifacts", lambda a: a["name"]) if adapter else F.array(F.lit("primary"))
    segments = F.col("segments")
    some = lambda wrong: F.exists(segments, wrong)
    box = lambda s: s["bbox"]
    orders = F.transform(segments, lambda s: s["reading_order"])
    ids = F.transform(segments, lambda s: s["segment_id"])
    return {
        "segments must be given": segments.isNull(),
        "artifacts consumed must be unique and include the primary one": (F.size(F.array_distinct(consumed)) != F.size(consumed)) | ~F.array_contains(consumed, "primary"),
        "artifacts consumed must be those of the source": F.lit(adapter is not None) & (F.size(F.array_except(consumed, names)) > 0),
        "capabilities used must be declared": F.size(F.array_except(used, declared)) > 0,
        "segment ids must be unique and non-empty": (F.size(F.array_distinct(ids)) != F.size(ids)) | some(lambda s: _blank(s["segment_id"])),
        "segments must be in reading order": (orders != F.array_sort(orders)) | some(lambda s: s["reading_order"] < 0),
        "unsupported role": some(lambda s: ~F.coalesce(s["role"].isin(*fixed.ROLES), F.lit(False))),
        "unsupported role confidence": some(lambda s: ~F.coalesce(s["role_confidence"].isin(*fixed.CONFIDENCES), F.lit(False))),
        "unsupported boundary": some(lambda s: ~F.coalesce(s["boundary_before"].isin(*fixed.BOUNDARIES), F.lit(False))),
        "segments need text and a role basis": some(lambda s: s["text"].isNull() | _blank(s["role_basis"])),
        "pages count from 1": some(lambda s: s["page"] < 1),
        "boxes must be ordered": some(lambda s: (box(s)["left"] > box(s)["right"]) | (box(s)["top"] > box(s)["bottom"])),
        "adapters may not set inclusion_override": some(lambda s: s["inclusion_override"].isNotNull()),
        "failed coverage cannot be analyzed": F.col("coverage")["status"] == "failed",
        "unsupported coverage status": ~F.coalesce(F.col("coverage")["status"].isin("complete", "partial", "failed"), F.lit(False)),
        "coverage counts must not be negative": F.least(*[F.col("coverage")[n] for n in ("matched_blocks", "unmatched_blocks", "ambiguous_blocks")]) < 0,
        "warnings must be non-empty": F.exists(F.coalesce("document_warnings", F.array().cast("array<string>")), _blank),
        "dependency names and versions must be non-empty": F.exists(F.map_entries(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))), lambda e: _blank(e["key"]) | _blank(e["value"])),
        "evidence must be complete": F.exists("extraction_evidence", lambda e: _blank(e["code"]) | _blank(e["value"]) | ~F.coalesce(e["confidence"].isin(*fixed.CONFIDENCES), F.lit(False))),
    }


def _result_checks(estimates: bool) -> dict[str, Column]:
    c = F.col("coverage")
    artifacts = F.col("source")["artifacts"].cast("array<struct<name:string,kind:string,media_type:string,sha256:string,byte_length:bigint>>")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda n, x: n + x)
    out = {
        "pages_extracted must not exceed page_count": c["pages_extracted"] > c["page_count"],
        "pages_with_text must not exceed pages_extracted": c["pages_with_text"] > c["pages_extracted"],
        "role counts must sum to segments_total": total(c["role_counts"]) != c["segments_total"],
        "classification_coverage must be between 0 and 1": ~c["classification_coverage"].between(0, 1),
        "counts must not be negative": F.least(*[c[n] for n in ("page_count", "pages_extracted", "pages_with_text", "segments_total", "unknown_role_count")]) < 0,
        "unknown_role_count must be that of the roles": F.coalesce(F.element_at(c["role_counts"], F.lit("unknown")), F.lit(0)) != c["unknown_role_count"],
        "classification_coverage must follow from the roles": (c["segments_total"] > 0)
        & (F.abs(c["classification_coverage"] * c["segments_total"] - (c["segments_total"] - c["unknown_role_count"])) > 1e-6),
        "the profile's hash must be a SHA-256": _not_sha256(F.col("profile")["sha256"]),
        "the source's hash must be a SHA-256": F.col("source")["sha256"].isNotNull() & _not_sha256(F.col("source")["sha256"]),
        "the configuration's hash must be a SHA-256": F.col("adapter")["configuration_sha256"].isNotNull() & _not_sha256(F.col("adapter")["configuration_sha256"]),
        "byte lengths must not be negative": (F.col("source")["byte_length"] < 0) | F.exists(artifacts, lambda a: a["byte_length"] < 0),
        "artifact names must be unique": F.size(F.array_distinct(F.transform(artifacts, lambda a: a["name"]))) != F.size(artifacts),
        "the primary artifact must be the source": F.exists(
            artifacts, lambda a: (a["name"] == "primary") & ~((a["sha256"] == F.col("source")["sha256"]) & (a["byte_length"] == F.col("source")["byte_length"]))
        ),
        "capabilities used must be declared": F.size(F.array_except(F.col("adapter")["capabilities_used"], F.col("adapter")["declared_capabilities"])) > 0,
        "warnings must be complete": F.exists("warnings", lambda w: _blank(w["code"]) | _blank(w["message"]) | ~F.coalesce(w["severity"].isin("info", "warning", "error"), F.lit(False))),
    }
    for m in fixed.METRICS:
        s, r = F.col("selection")[m], F.col("metrics")[m]
        given = r["status"].isin("calculated", "estimated")
        out |= {
            f"{m}: included roles must sum to included segments": total(s["included_role_counts"]) != s["included_segment_count"],
            f"{m}: excluded roles must sum to excluded segments": total(s["excluded_role_counts"]) != s["excluded_segment_count"],
            f"{m}: given metrics have a value and no reason": given & (r["value"].isNull() | r["reason"].isNotNull()),
            f"{m}: other metrics have a reason and no value": ~given & (r["value"].isNotNull() | r["reason"].isNull()),
            f"{m}: selected segments must be all segments": s["included_segment_count"] + s["excluded_segment_count"] != c["segments_total"],
            f"{m}: counts must not be negative": F.least(s["included_segment_count"], s["excluded_segment_count"]) < 0,
        }
        if estimates:
            t, x = r["reliability"], r["reliability"]["sensitivity"]
            out |= {
                f"{m}: estimates have a reliability": (r["status"] == "estimated") & t.isNull(),
                f"{m}: unsupported reliability level": ~t["level"].isin(*fixed.LEVELS),
                f"{m}: reasons must be given, each once": t.isNotNull() & ((F.size(t["reason_codes"]) == 0) | (F.size(F.array_distinct(t["reason_codes"])) != F.size(t["reason_codes"]))),
                f"{m}: shares must be between 0 and 1": ~(t["unknown_word_share"].between(0, 1) & t["classification_coverage"].between(0, 1)),
                f"{m}: reliability counts must not be negative": F.least(t["unknown_segment_count"], t["unknown_word_count"], t["failed_page_count"]) < 0,
                f"{m}: the value with unknown roles must be the value": x["included_unknown_value"] != r["value"],
                f"{m}: deltas go with both values": t.isNotNull() & (x["excluded_unknown_value"].isNull() != (x["absolute_delta"].isNull() | x["relative_delta_percent"].isNull())),
                f"{m}: deltas must not be negative": F.least(x["absolute_delta"], x["relative_delta_percent"]) < 0,
            }
    return out


def _failing(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]))
    return rows.select(key, F.explode(named).alias("violation"))


def violations(documents: DataFrame, key: str = "doc_id", adapter: Adapter | None = None) -> DataFrame:
    """What is wrong with normalized documents: a row for each document and fault.
    With their adapter, what they took from their sources is checked too."""
    return _failing(with_document_fields(documents).where("error is null"), _document_checks(adapter), key)


def result_violations(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for results."""
    estimates = "reliability" in results.schema["metrics"].dataType[fixed.METRICS[0]].dataType.names
    return _failing(results.where("error is null"), _result_checks(estimates), key)


def validate(documents: DataFrame, adapter: Adapter | None = None) -> None:
    found = violations(documents, adapter=adapter).take(1)
    if found:
        raise AdapterContractError(f"document {found[0]['doc_id']}: {found[0]['violation']}")


def conformance(adapter: Adapter, sources: DataFrame, config: Mapping | None = None) -> dict:
    """Report on an adapter over given sources; raises at the first fault."""
    settings = dict(config or {})
    settings_hash = configuration_sha256(settings)
    adapter.check_configuration(settings)
    assessed = sources.withColumn("support", adapter.assess(sources))
    refused = assessed.where(F.col("support.status") == "unsupported").select("doc_id", "support.reason").take(1)
    if refused:
        raise AdapterContractError(refused[0]["reason"] or f"Adapter {adapter.reference} reported the source as unsupported")
    first, second = (adapter.extract(assessed, settings) for _ in range(2))
    missing = [n for n, _ in DOCUMENT_FIELDS if n not in first.columns and n not in ("artifacts_consumed", "capabilities_used")]
    if missing:
        raise AdapterContractError("adapter output lacks " + ", ".join(missing))
    for made in (first, second):
        failed = made.where("error is not null").select("error.message").take(1)
        if failed:
            raise AdapterContractError(failed[0]["message"])
        validate(made, adapter)
        same = F.col("made.sha256").eqNullSafe(F.col("given.sha256")) & F.col("made.kind").eqNullSafe(F.col("given.kind")) & F.col("made.artifacts").eqNullSafe(F.col("given.artifacts"))
        other = made.alias("made").join(sources.alias("given"), "doc_id", "full").where(~same).take(1)
        if other:
            raise AdapterContractError(f"document {other[0]['doc_id']}: the identity of the source must not change")
    projected = [F.to_json(F.struct(*[n for n, _ in DOCUMENT_FIELDS if n in first.columns])).alias("all")]
    a, b = (made.select("doc_id", *projected) for made in (first, second))
    if a.exceptAll(b).take(1) or b.exceptAll(a).take(1):
        raise AdapterContractError(f"Adapter {adapter.reference} is not deterministic for the frozen inputs")
    return {"adapter_reference": adapter.reference, "configuration_sha256": settings_hash, "checks": list(CHECKS), "conformant": True}
