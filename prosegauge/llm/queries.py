"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import (
    decontamination,
    fingerprints,
    language_id,
    licenses,
    line_dedup,
    mixing,
    quality,
    simhash,
    substring_dedup,
    token_counts,
)
from prosegauge.runtime import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP1_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS k FROM parts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
repeated AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, repeated.key IS NOT NULL AS dropped FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), share=1.0, max_repeats=3).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS place,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER q AS k, coalesce(sum(n) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, (SELECT sum(n) FROM s)::DOUBLE AS total
  FROM s WINDOW q AS (ORDER BY n / w, source)),
f AS (SELECT min(k) AS first_open FROM o WHERE (total - 3 * capped) * w / open_w <= 3 * n),
p AS (SELECT total - 3 * capped AS rest, open_w AS rest_w FROM o, f WHERE k = first_open),
t AS (SELECT source, n, CASE WHEN k < first_open THEN 3.0::DOUBLE * n ELSE rest * w / rest_w END AS target FROM o, f, p),
b AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n)) END::BIGINT AS whole FROM t),
c AS (SELECT *, target - whole * n AS budget FROM b),
h AS (SELECT source, place, sum(size)::BIGINT AS words FROM d GROUP BY source, place),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) - words AS before FROM h),
e AS (
  SELECT r.source, max(r.place) AS last, arg_max(r.words <= 2 * (c.budget - r.before), r.place) AS take
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source WHERE r.before < c.budget GROUP BY r.source)
SELECT d.doc_id, d.size, c.n AS source_size, c.target,
  (d.size * least(3, c.whole + CASE WHEN d.place < e.last OR (d.place = e.last AND e.take) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


#: The vocabulary file of a public tokenizer, as the environment gives it.
RANKS = os.environ.get("PROSEGAUGE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=3, radius=3, segments=2)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), usable=_remainder(3) != 1)
    scored = quality.score(docs, model)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


def _op7_words(name: str, keys: str) -> str:
    return f"""SELECT {keys}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {name}"""


OP7_SQL = f"""
WITH d AS ({_op7_words("documents", "row_number() OVER () AS r, doc_id")}), b AS ({_op7_words("benchmark", "item_id")} WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, n, s, item_id FROM dw JOIN bw USING (n, t)),
hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit, (count(DISTINCT p) FILTER (n = 13))::BIGINT AS n_full
  FROM (SELECT r, n, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_full, 0)::BIGINT AS n_full
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: ``source/shelf/name``; every hundredth id is a
    LICENSE file, every two hundredth one of the source's own directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    shelf = F.when(F.col("doc_id") % 200 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 1000).cast("string")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), shelf, name)
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(files).select("doc_id", "path", "own_license", "own_cosine", "license", "license_from")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, window=35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM win JOIN rep USING (t))),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM tok ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(_remainder(4) != 2))
    # the contract wants a language for every text with a letter; what would be rejected is marked
    found = language_id.identify(docs.select("doc_id", "text"), model, reject=False)
    return found.withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_token_counts": op3_token_counts,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_quality": op6_quality,
        "op7_decontamination": op7_decontamination,
        "op8_licenses": op8_licenses,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_language_id": op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op7_decontamination": OP7_SQL, "op9_substring_dedup": OP9_SQL}
