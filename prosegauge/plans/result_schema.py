"""The schemas of results and of profiles, as Spark types.

Three versions of the result: 1.1.0 (calculated), 1.2.0 (estimates: metrics have a
reliability) and 1.3.0 (word-processor files: excluded content by category).  They
are made by rule from the lists of metrics and method slots, and independently of the
columns that ``analyze`` builds, so that one can be held against the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from prosegauge import fixed
from prosegauge.errors import AdapterContractError

VERSIONS = ("1.1.0", "1.2.0", "1.3.0")
PROFILE_VERSION = "1.1.0"


def _struct(**fields: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">"


def _strings(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "string")


def _longs(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "bigint")


EVIDENCE = "array<" + _struct(**_strings("code", "value", "confidence")) + ">"
METHOD = _struct(**_strings("status", "id", "version", "reason"))
SENSITIVITY = _struct(**dict.fromkeys(("included_unknown_value", "excluded_unknown_value", "absolute_delta", "relative_delta_percent"), "double"))
RELIABILITY = _struct(
    level="string", method=_struct(**_strings("status", "id", "version")), classification_coverage="double",
    **_longs("unknown_segment_count", "unknown_word_count"), unknown_word_share="double", failed_page_count="bigint",
    sensitivity=SENSITIVITY, reason_codes="array<string>",
)


def _metric(estimate: bool) -> str:
    fields = _strings("metric_id", "status", "unit") | {"method": METHOD, "value": "double", "unrounded_value": "double", "components": "map<string,double>", "reason": "string"}
    return _struct(**fields, **({"reliability": RELIABILITY} if estimate else {}))


def result_schema(version: str) -> StructType:
    """The type of a result record, without the key that tables of them have."""
    if version not in VERSIONS:
        raise ValueError(f"no result schema {version}; there are " + ", ".join(VERSIONS))
    artifact = _struct(**_strings("name", "kind", "media_type", "sha256"), byte_length="bigint")
    source = _struct(
        kind="string", sha256="string", byte_length="bigint", **_strings("production_path", "document_id", "revision"),
        observed_pdf_metadata="map<string,string>", artifacts=f"array<{artifact}>",
    )
    adapter = _struct(
        **_strings("id", "version"), dependencies="map<string,string>",
        **_strings("contract_version", "distribution", "distribution_version", "configuration_sha256"),
        **dict.fromkeys(("declared_capabilities", "capabilities_used"), "array<string>"),
        extraction_coverage=_struct(status="string", **_longs("matched_blocks", "unmatched_blocks", "ambiguous_blocks")),
        fallback_history="array<string>", support_evidence=EVIDENCE, extraction_evidence=EVIDENCE,
    )
    coverage = _struct(
        **_longs("page_count", "pages_extracted", "pages_with_text"), extraction_error_pages="array<int>", segments_total="bigint",
        role_counts="map<string,bigint>", unknown_role_count="bigint", classification_coverage="double",
    )
    counts = _struct(
        **_longs("included_segment_count", "excluded_segment_count"),
        **dict.fromkeys(("included_role_counts", "excluded_role_counts"), "map<string,bigint>"), unknown_role_policy="string",
    )
    warning = _struct(**_strings("code", "severity", "message"), pages="array<int>")
    per_metric = lambda kind: _struct(**dict.fromkeys(fixed.METRICS, kind))
    fields = _strings("schema_version", "analysis_id", "generated_at") | {
        "engine": _struct(**_strings("name", "version")),
        "source": source,
        "adapter": adapter,
        "profile": _struct(**_strings("id", "version", "status", "sha256")),
        "result_basis": "string",
        "methods": _struct(**dict.fromkeys(fixed.METHOD_SLOTS, METHOD)),
        "coverage": coverage,
        "selection": per_metric(counts),
        "metrics": per_metric(_metric(version == "1.2.0")),
        "warnings": f"array<{warning}>",
    }
    if version == "1.3.0":
        fields["excluded_word_content"] = "map<string," + _struct(**_longs("words", "segments")) + ">"
    return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in (fields | {"error": _struct(**_strings("code", "message"))}).items()))


def differences(found: DataType, wanted: DataType, at: str = "") -> list[str]:
    """Where two types differ, by path; what may be null does not matter."""
    if isinstance(found, StructType) and isinstance(wanted, StructType):
        out = [f"{at}.{n} is missing" for n in wanted.names if n not in found.names] + [f"{at}.{n} is unknown" for n in found.names if n not in wanted.names]
        return out + [d for n in wanted.names if n in found.names for d in differences(found[n].dataType, wanted[n].dataType, f"{at}.{n}")]
    if isinstance(found, ArrayType) and isinstance(wanted, ArrayType):
        return differences(found.elementType, wanted.elementType, at + "[]")
    if isinstance(found, MapType) and isinstance(wanted, MapType):
        return differences(found.keyType, wanted.keyType, at + "{key}") + differences(found.valueType, wanted.valueType, at + "{}")
    return [] if found == wanted else [f"{at} is {found.simpleString()}, not {wanted.simpleString()}"]


def check_results(results: DataFrame, version: str) -> None:
    """Refuse a table of results that is not of the schema."""
    wrong = differences(results.drop("doc_id").schema, result_schema(version))
    if wrong:
        raise AdapterContractError(f"results are not of schema {version}: " + "; ".join(wrong))


def profile_schema() -> StructType:
    """The type of a profile's JSON document."""
    rule = _struct(**dict.fromkeys(("include_roles", "exclude_roles"), "array<string>"), unknown_role_policy="string")
    fields = _strings("schema_version", "profile_id", "profile_version", "status", "description") | {
        "pipeline": _struct(**_strings("id", "version")),
        "metrics": _struct(**dict.fromkeys(fixed.METRICS, rule)),
        "methods": _struct(**dict.fromkeys(fixed.METHOD_SLOTS, METHOD)),
    }
    return StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields.items()))
