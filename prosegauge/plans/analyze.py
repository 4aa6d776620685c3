"""From sources or normalized documents to results, one row a document.

``measure_documents`` is the engine: it takes normalized documents (``schema``) and a
profile, and returns counts, metrics, reliability, coverage and warnings.  It is
narrow for markup and plain text (no exchange at all); page-based documents are
assembled by their adapters before.  Both unknown-role scenarios of an estimate
are counted in the same pass.

``analysis_results`` shapes that as a nested, text-free record with provenance;
``metric_rows`` as a long table.  A document that cannot be measured has an
``error`` (code and message) and never stops the others.

Defined cases: documents without segments have 0 words and no ratios; documents
with unknown roles under a strict profile have no metrics but a reason; sentences
without words are an ``analysis_error``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge import __version__, fixed
from prosegauge.errors import AdapterContractError, AnalysisError, InputError
from prosegauge.errors import GaugeError
from prosegauge.functions import sentences, tokens
from prosegauge.functions.chars import half_even, strip
from prosegauge.operators import measure, pages, reflow, selection
from prosegauge.operators.reliability import reliability
from prosegauge.plans.registry import ADAPTERS, choose_adapter, configuration_sha256
from prosegauge.schema import exploded, gathered_segments, with_document_fields
from prosegauge.sources.files import SourceBundle, bundle_frame
from prosegauge.sources.profiles import Profile, load_profile

ENGINE = "prosegauge"
IDENTIFIERS = ("production_path", "document_id", "revision")


def _texts(segments: Column) -> Column:
    return F.transform(segments, lambda s: s["text"])


def flat_reflow(documents: DataFrame) -> DataFrame:
    """Documents of flat pages with their lines joined to blocks, and ``reflow``."""
    blocks = reflow.joined_blocks(exploded(documents, "doc_id"))
    found = blocks.groupBy("doc_id").agg(gathered_segments(blocks.columns).alias("segments"), reflow.reflow_facts().alias("reflow"))
    made = documents.drop("segments").join(found, "doc_id", "left")
    return made.withColumn("segments", F.coalesce("segments", F.array().cast(made.schema["segments"].dataType)))


def measure_documents(documents: DataFrame, profile: Profile, *, estimate: str = "none") -> DataFrame:
    """``documents`` with scope counts, metrics and, for estimates, those without
    segments of unknown role (prefix ``known_``)."""
    version = profile.passive_version
    content_rule, read_rule = profile.scope_rule("document_content"), profile.scope_rule("readability_sentences")
    is_estimate = estimate != "none"
    docs = flat_reflow(documents) if estimate == "flat_pdf" else documents
    segments = F.col("segments")
    unknown = F.exists(segments, lambda s: s["role"] == "unknown")
    strict = lambda rule: unknown if rule.unknown_policy == "unable_to_calculate" else F.lit(False)
    kept = docs.columns
    docs = docs.withColumns({"content_unable": strict(content_rule), "readability_unable": strict(read_rule)})
    content = F.when(~F.col("content_unable"), selection.selected_array(segments, content_rule.include))
    read = F.when(~F.col("readability_unable"), selection.selected_array(segments, read_rule.include))
    docs = docs.select(*kept, "content_unable", "readability_unable", content.alias("_content"), read.alias("_read"))
    if is_estimate:  # unknown segments without any word are no part of the sentence scope
        # any ASCII letter is part of a word
        words = lambda s: s["text"].rlike("[A-Za-z]") | (F.size(tokens.tokens(s["text"])) > 0)
        docs = docs.withColumn("_read", F.filter("_read", lambda s: (s["role"] != "unknown") | words(s)))
    known = lambda c: F.filter(c, lambda s: s["role"] != "unknown")
    text = {"_content_text": sentences.blocks_of(_texts(F.col("_content"))), "_read_text": sentences.blocks_of(_texts(F.col("_read")))}
    if is_estimate:
        text |= {
            "_known_content": sentences.blocks_of(_texts(known(F.col("_content")))),
            "_known_read": sentences.blocks_of(_texts(known(F.col("_read")))),
            # words of segments joined by line feeds (each may see the next one's start)
            "_unknown_words": F.array_join(_texts(F.filter(segments, lambda s: s["role"] == "unknown")), "\n"),
            "_total_words": F.array_join(_texts(segments), "\n"),
        }
    docs = docs.withColumns(text)
    scopes = {"": ("_read_text", "_content_text")} | ({"known_": ("_known_read", "_known_content")} if is_estimate else {})
    made = measure.with_batch_counts(docs, scopes, version=version, words=("_unknown_words", "_total_words") if is_estimate else ())
    for prefix in scopes:
        made = made.withColumns(measure.metric_columns(prefix))
    error = F.coalesce(*[measure.count_error(prefix) for prefix in scopes])
    failed = F.when(error.isNotNull(), F.struct(F.lit(AnalysisError.code).alias("code"), error.alias("message")))
    made = made.withColumn("error", F.coalesce("error", failed))
    return made.drop("_content", "_read", "_content_text", "_read_text", "_known_content", "_known_read")


def _coverage() -> Column:
    segments = F.col("segments")
    n = F.size(segments).cast("bigint")
    unknown = F.size(F.filter(segments, lambda s: s["role"] == "unknown")).cast("bigint")
    own = F.transform(F.filter(segments, lambda s: s["page"].isNotNull() & (strip(s["text"]) != "")), lambda s: s["page"])
    with_text = F.size(F.array_union(own, F.coalesce("continuation_pages", F.array().cast("array<int>"))))
    failed = F.coalesce(F.size("error_pages"), F.lit(0))
    return F.struct(
        F.col("page_count").cast("bigint").alias("page_count"),
        F.greatest(F.lit(0), F.col("page_count") - failed).cast("bigint").alias("pages_extracted"),
        with_text.cast("bigint").alias("pages_with_text"),
        F.col("error_pages").alias("extraction_error_pages"),
        n.alias("segments_total"),
        selection.role_count_map(segments).alias("role_counts"),
        unknown.alias("unknown_role_count"),
        F.coalesce(F.try_divide(n - unknown, n), F.lit(0.0)).alias("classification_coverage"),
    )


def _selection(profile: Profile, metric: str) -> Column:
    rule = profile.rules[metric]
    inside = selection.selected_array(F.col("segments"), rule.include)
    outside = selection.others_array(F.col("segments"), rule.include)
    return F.struct(
        F.size(inside).cast("bigint").alias("included_segment_count"),
        F.size(outside).cast("bigint").alias("excluded_segment_count"),
        selection.role_count_map(inside).alias("included_role_counts"),
        selection.role_count_map(outside).alias("excluded_role_counts"),
        F.lit(rule.unknown_policy).alias("unknown_role_policy"),
    )


def _method(profile: Profile, slot: str) -> Column:
    m = profile.methods[slot]
    value = lambda x: F.lit(x).cast("string")
    return F.struct(
        F.lit("configured" if m.id else "unavailable").alias("status"), value(m.id).alias("id"), value(m.version).alias("version"), value(m.reason).alias("reason")
    )


def _components(metric: str) -> Column:
    """Map of what a metric was made of; entries without a value are left out."""
    value = lambda name: F.col(name).cast("double")
    if metric == "word_count":
        entries = [("word_count", value("word_count"))]
    else:
        entries = [
            ("word_count", value("readability_word_count")),
            ("sentence_count", value("sentence_count")),
            ("paragraph_count", value("paragraph_count")),
            ("character_count", value("character_count")),
            ("syllable_count", value("syllable_count")),
            ("sentences_per_paragraph", F.try_divide(F.col("sentence_count"), F.col("paragraph_count"))),
        ]
        if metric == "passive_sentence_percentage":
            entries.append(("passive_sentence_count", value("passive_sentence_count")))
        entries.append(("unrounded_value", F.col(metric)))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


def _metric(profile: Profile, metric: str, estimate: str) -> Column:
    is_words = metric == "word_count"
    unable = F.col("content_unable" if is_words else "readability_unable")
    raw = F.col(metric).cast("double")
    value = raw if is_words else half_even(raw, 2)
    reason = F.when(unable, fixed.UNKNOWN_ROLE_REASON).when(raw.isNull(), fixed.NO_DENOMINATOR_REASON)
    given = reason.isNull()
    kind = "map<string,double>"
    trust = F.lit(None)
    if estimate != "none":
        known = F.col("known_" + metric).cast("double")
        flat = estimate == "flat_pdf"
        coverage = F.col("coverage_summary")
        trust = F.when(
            given,
            reliability(
                metric,
                included=value,
                excluded=known if is_words else half_even(known, 2),
                classification_coverage=coverage["classification_coverage"],
                unknown_segments=coverage["unknown_role_count"],
                unknown_words=F.col("_unknown_words"),
                total_words=F.col("_total_words"),
                failed_pages=F.size("error_pages"),
                ceiling="low" if flat else None,
                more_codes=("flat_pdf_semantic_structure_unavailable",) if flat else (),
            ),
        )
    k = fixed.METRICS.index(metric)
    fields = [
        F.lit(metric).alias("metric_id"),
        F.when(~given, "unable_to_calculate").otherwise("calculated" if estimate == "none" else "estimated").alias("status"),
        F.lit(fixed.UNITS[k]).alias("unit"),
        _method(profile, fixed.SLOT_OF_METRIC[k]).alias("method"),
        F.when(given, value).alias("value"),
        F.when(given, raw).alias("unrounded_value"),
        F.when(unable, F.create_map().cast(kind)).otherwise(_components(metric)).alias("components"),
        reason.alias("reason"),
    ]
    return F.struct(*fields, *([trust.alias("reliability")] if estimate != "none" else []))


def _warning(when: Column, code: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.array().cast("array<int>").alias("pages")))


def _warnings(profile: Profile, estimate: str) -> Column:
    always = F.lit(True)
    found = [_warning(always, "profile_provisional", "warning", F.lit(f"Profile {profile.reference} is provisional."))]
    text = "%d semantic block fragment(s) without terminal sentence punctuation were excluded from readability sentence metrics."
    found.append(_warning(F.col("fragment_count") > 0, "unterminated_semantic_fragments_excluded", "info", F.format_string(text, F.col("fragment_count"))))
    if estimate == "tagged_pdf":
        text = "PDF metrics are estimates with versioned coverage and unknown-role sensitivity evidence."
        found.append(_warning(always, "pdf_estimate_reliability_attached", "info", F.lit(text)))
    elif estimate == "flat_pdf":
        text = (
            "Flat PDF metrics are low-reliability estimates because paragraphs and semantic roles were reconstructed from visual text lines "
            f"rather than supplied by authoritative source structure. {reflow.METHOD} reconstructed %d block(s) from %d line(s), "
            "with %s%% line-geometry coverage."
        )
        facts = F.col("reflow")
        n = lambda name: F.coalesce(facts[name], F.lit(0).cast("bigint"))
        share = half_even(F.coalesce(F.try_divide(facts["geometry_line_count"], facts["source_line_count"]), F.lit(0.0)) * 100.0, 1)
        message = F.format_string(text, n("paragraph_count"), n("source_line_count"), share.cast("string"))
        found.append(_warning(always, "flat_pdf_estimate_reliability_attached", "warning", message))
    from_adapter = F.transform(
        F.coalesce("document_warnings", F.array().cast("array<string>")),
        lambda m: F.struct(F.lit("adapter_warning").alias("code"), F.lit("warning").alias("severity"), m.alias("message"), F.array().cast("array<int>").alias("pages")),
    )
    return F.concat(F.array_compact(F.array(*found)), from_adapter)


def _excluded_word_content() -> Column:
    """Map from category of front matter to its words and segments."""
    own = F.filter("segments", lambda s: s["role_basis"].startswith("word_structure:"))

    def of(category: str) -> Column:
        mine = F.filter(own, lambda s: s["role_basis"] == "word_structure:" + category)
        words = F.aggregate(mine, F.lit(0), lambda n, s: n + F.size(tokens.tokens(s["text"])))
        counts = F.struct(words.cast("bigint").alias("words"), F.size(mine).cast("bigint").alias("segments"))
        return F.struct(F.lit(category).alias("key"), counts.alias("value"))

    return F.map_from_entries(F.filter(F.array(*map(of, fixed.WORD_ROLES)), lambda e: e["value"]["segments"] > 0))


def analysis_results(measured: DataFrame, profile: Profile, *, adapter=None, estimate: str = "none", config_sha256: str | None = None) -> DataFrame:
    """One nested record a document, without any of its text.

    ``analysis_id`` and ``generated_at`` differ from run to run, nothing else does.
    """
    is_word = adapter is not None and adapter.id == "word-derived-html-adapter"
    schema_version = "1.3.0" if is_word else "1.2.0" if estimate != "none" else "1.1.0"
    text = lambda x: F.lit(x).cast("string")
    rows = with_document_fields(measured).withColumn("coverage_summary", _coverage())
    identity = F.struct(
        text(adapter.id if adapter else None).alias("id"),
        text(adapter.version if adapter else None).alias("version"),
        F.col("dependencies").alias("dependencies"),
        text(adapter.contract_version if adapter else None).alias("contract_version"),
        text(adapter.distribution if adapter else None).alias("distribution"),
        text(adapter.distribution_version if adapter else None).alias("distribution_version"),
        text(config_sha256).alias("configuration_sha256"),
        F.array(*map(F.lit, sorted(adapter.capabilities if adapter else ()))).cast("array<string>").alias("declared_capabilities"),
        F.array_sort(F.coalesce("capabilities_used", F.array(*map(F.lit, adapter.capabilities if adapter else ())).cast("array<string>"))).alias("capabilities_used"),
        F.col("coverage").alias("extraction_coverage"),
        F.array().cast("array<string>").alias("fallback_history"),
        F.col("support")["evidence"].alias("support_evidence"),
        F.col("extraction_evidence").alias("extraction_evidence"),
    )
    source = F.struct(
        "kind", "sha256", "byte_length", "production_path", "document_id", "revision", F.col("observed_pdf_metadata").alias("observed_pdf_metadata"), "artifacts"
    )
    fine = F.col("error").isNull()
    when_fine = lambda c: F.when(fine, c)
    columns = [
        "doc_id",
        F.lit(schema_version).alias("schema_version"),
        F.uuid().alias("analysis_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generated_at"),
        F.struct(F.lit(ENGINE).alias("name"), F.lit(__version__).alias("version")).alias("engine"),
        source.alias("source"),
        identity.alias("adapter"),
        F.struct(F.lit(profile.id).alias("id"), F.lit(profile.version).alias("version"), F.lit(profile.status).alias("status"), F.lit(profile.sha256).alias("sha256")).alias("profile"),
        F.lit("structured_estimate").alias("result_basis"),
        F.struct(*[_method(profile, s).alias(s) for s in fixed.METHOD_SLOTS]).alias("methods"),
        when_fine(F.col("coverage_summary")).alias("coverage"),
        when_fine(F.struct(*[_selection(profile, m).alias(m) for m in fixed.METRICS])).alias("selection"),
        when_fine(F.struct(*[_metric(profile, m, estimate).alias(m) for m in fixed.METRICS])).alias("metrics"),
        when_fine(_warnings(profile, estimate)).alias("warnings"),
        *([when_fine(_excluded_word_content()).alias("excluded_word_content")] if is_word else []),
        "error",
    ]
    return rows.select(*columns)


def metric_rows(measured: DataFrame, profile: Profile, *, estimate: str = "none") -> DataFrame:
    """One row a document and metric."""
    rows = measured.withColumn("coverage_summary", _coverage())
    # no filter before: it would be pushed below the counts and bring a copy of them along; and an array made here
    # is exploded as it is, where one that may be null or empty would be made again for a filter that says it is not
    metrics = F.array(*[F.when(F.col("error").isNull(), _metric(profile, m, estimate)) for m in fixed.METRICS])
    return rows.select("doc_id", F.explode(metrics).alias("m")).where("m is not null").select("doc_id", "m.*")


def plain_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain text as normalized documents: each line that is not blank is a body block."""
    from prosegauge.functions.lines import normalized
    from prosegauge.schema import segment

    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normalized), lambda t: t != "")
    made = docs.select(F.col(key).alias("doc_id"), lines.alias("_lines"))
    segments = F.transform(
        "_lines",
        lambda t, k: segment(
            segment_id=F.format_string("line-%05d", k + 1), reading_order=k, text=t, role=F.lit("body"), role_confidence=F.lit("high"),
            role_basis=F.lit("plain_text:line"), boundary_before=F.lit("paragraph"), warnings=F.array().cast("array<string>"),
        ),
    )
    empty = F.array()
    return with_document_fields(made, segments=segments, page_count=F.lit(0), error_pages=empty, continuation_pages=empty, document_warnings=empty).drop("_lines")


def analyze(
    sources: DataFrame,
    profile: str | Profile,
    *,
    adapter: str | None = None,
    config: Mapping | None = None,
) -> DataFrame:
    """Results of a table of ``sources`` (``sources.files``), one row a source.

    What is wrong with the request raises; what is wrong with a source is in its
    ``error``.
    """
    chosen = load_profile(profile) if isinstance(profile, str) else profile
    pipeline, plugin = choose_adapter(chosen, adapter)
    chosen.passive_version  # noqa: B018  refuses profiles with other methods
    settings = dict(config or {})
    settings_hash = configuration_sha256(settings)
    plugin.check_configuration(settings)
    wrong = (
        F.when(F.col("kind") != pipeline.source_kind, F.lit(f"Pipeline {pipeline.reference} accepts one {pipeline.source_kind.upper()} artifact"))
        .when((F.size("artifacts") > 1) & F.lit(not pipeline.accepts_auxiliaries), F.lit(f"Pipeline {pipeline.reference} does not accept auxiliary artifacts"))
        .when(F.col("support")["status"] == "unsupported", F.col("support")["reason"])
    )
    blank = F.array_compact(F.array(*[F.when(F.trim(F.col(n)) == "", F.lit(n)) for n in IDENTIFIERS]))
    unnamed = F.when(F.size(blank) > 0, F.concat(F.array_join(blank, ", "), F.lit(" must not be empty")))
    assessed = sources.withColumn("support", plugin.assess(sources)).withColumns({"_unnamed": unnamed, "_wrong": F.coalesce(unnamed, wrong)})
    documents = plugin.extract(assessed, settings).drop("content", "auxiliaries")
    code = F.when(F.col("_unnamed").isNotNull(), InputError.code).otherwise(AdapterContractError.code)
    refused = F.when(F.col("_wrong").isNotNull(), F.struct(code.alias("code"), F.col("_wrong").alias("message")))
    documents = documents.withColumn("error", F.coalesce(refused, F.col("error"))).drop("_wrong", "_unnamed")
    measured = measure_documents(documents, chosen, estimate=pipeline.estimate)
    return analysis_results(measured, chosen, adapter=plugin, estimate=pipeline.estimate, config_sha256=settings_hash)


def without_nulls(value):
    """A record as JSON values: fields without a value are left out."""
    if isinstance(value, Mapping):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [without_nulls(v) for v in value]
    return value


def analyze_one(
    spark: SparkSession,
    source: SourceBundle | object,
    *,
    profile: str,
    adapter: str | None = None,
    production_path: str = "unknown",
    document_id: str | None = None,
    revision: str | None = None,
    config: Mapping | None = None,
) -> dict:
    """Result of one source held by the caller; a source's error raises."""
    for name, value in zip(IDENTIFIERS, (production_path, document_id, revision)):
        if value is not None and not (isinstance(value, str) and value.strip()):
            raise InputError(f"{name} must be a non-empty string")
    bundle = source if isinstance(source, SourceBundle) else SourceBundle.from_pdf(source)
    sources = bundle_frame(spark, [bundle], production_path=production_path, document_id=document_id, revision=revision)
    row = analyze(sources, profile, adapter=adapter, config=config).first().asDict(recursive=True)
    if row["error"]:
        kinds = {c.code: c for c in _errors(GaugeError)}
        raise kinds.get(row["error"]["code"], AnalysisError)(row["error"]["message"])
    return without_nulls({k: v for k, v in row.items() if k not in ("doc_id", "error")})


def _errors(kind: type) -> list[type]:
    return [kind, *(e for sub in kind.__subclasses__() for e in _errors(sub))]


def inspect_support(sources: DataFrame, adapter: str | None = None) -> DataFrame:
    """Whether adapters can read sources: one row a source and adapter, nothing is
    chosen or extracted."""
    chosen = [ADAPTERS.resolve(adapter)] if adapter else ADAPTERS.adapters()
    each = F.array(*[F.struct(F.lit(a.reference).alias("adapter"), a.assess(sources).alias("assessment")) for a in chosen])
    return sources.select("doc_id", F.explode(each).alias("a")).select("doc_id", "a.adapter", "a.assessment.*")


__all__ = [
    "analysis_results", "analyze", "analyze_one", "flat_reflow", "inspect_support", "measure_documents", "metric_rows", "pages",
    "plain_documents", "without_nulls",
]
