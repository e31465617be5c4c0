"""The queries of this package for the entry module, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.bpe import bpe_digests
from inkwell.llm.fingerprints import fingerprint_documents
from inkwell.llm.licenses import scan_licenses
from inkwell.llm.packing import pack_documents
from inkwell.llm.quality import quality_rules
from inkwell.llm.secret_scan import scan_secrets
from inkwell.llm.sharding import shard_documents
from inkwell.llm.simhash import near_duplicates
from inkwell.llm.substring import repeated_passages
from inkwell.llm.toxicity import score_toxicity, train


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), n_shards=40)


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), radius=3, width=3, seed=42)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), capacity=1024, end_id=2)


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_soft", "host_failed")
    return quality_rules(documents(spark, sf_dir)).select(*kept)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_shards, op2_simhash_near_dup, op3_best_fit_packing, op4_license_rules, op5_chunk_dedup, op6_ordinal_toxicity, op7_entropy_secrets, op8_multiset_fingerprints, op9_merge_replay, op10_host_quality)
}

QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, source AS host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  (CASE WHEN 100 * n_symbols > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 1 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 1 ELSE 0 END)::INT AS n_soft FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR n_soft > 0) AS f FROM j GROUP BY host),
p AS (SELECT m, CASE WHEN v > 1e-9 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 10 END AS s FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h)),
v AS (SELECT host, (f + m * s) / (n + s) > 0.3 AS host_failed FROM h CROSS JOIN p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_soft < 2 AND NOT (n_soft > 0 AND host_failed) AS kept, n_soft, host_failed
FROM j JOIN v ON j.host IS NOT DISTINCT FROM v.host"""

ORACLE_SQL: dict[str, str] = {"op10_host_quality": QUALITY_SQL}
