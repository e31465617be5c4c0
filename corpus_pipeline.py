"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns documents of the same columns, the last one the packed pieces.
A stage sees all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.jaccard import one_of_each
from inkwell.llm.packing import pack_documents
from inkwell.llm.quality import keep_good
from inkwell.llm.secret_scan import redact_secrets
from inkwell.llm.substring import remove_passages
from inkwell.scratch import Scope, materialize


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; each row is judged by itself."""
    return keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; of rows equal in id and text, one.

    Candidates have SimHash fingerprints over shingles of five words that differ in few bits; near-duplicates share 0.8
    or more of their shingles (exact Jaccard). The three words and three bits of op2's contract are for op2 only.
    """
    return one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document repeats from one with a smaller id are cut; what has no words left goes."""
    return _counted(remove_passages(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind."""
    return _counted(redact_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024."""
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dup", near_dup_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: The fingerprints, chunks and token ids of the stages are beyond SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scope() as scope:  # what a stage wrote on its way goes with it
            docs = scope.keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
