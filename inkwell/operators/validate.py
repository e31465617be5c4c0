"""Checks as DataFrames of (entity, error), and the assertion that none is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Rows that a check has found."""


def not_unique(rows: DataFrame, key: list[str], entity: Column, what: str) -> DataFrame:
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.first(entity).alias("entity")).filter("_n > 1")
    return twice.select("entity", F.lit(f"duplicate {what}").alias("error"))


def not_found(rows: DataFrame, key: list[str], owners: DataFrame, owner_key: list[str], entity: Column, what: str) -> DataFrame:
    """Rows whose key (if it has no null) is no key of owners: a foreign key check."""
    wanted = rows.dropna(subset=key)
    named = owners.select(*[F.col(b).alias(a) for a, b in zip(key, owner_key, strict=True)]).distinct()
    return wanted.join(named, key, "left_anti").select(entity.alias("entity"), F.lit(f"unknown {what}").alias("error"))


def wrong(rows: DataFrame, bad: Column, entity: Column, what: str) -> DataFrame:
    return rows.filter(F.coalesce(bad, F.lit(False))).select(entity.alias("entity"), F.lit(what).alias("error"))


def gather(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(errors: DataFrame, limit: int = 50) -> None:
    """Raise with the first `limit` errors, if there are any."""
    found = errors.orderBy("entity", "error").limit(limit).collect()
    if found:
        raise ValidationError("; ".join(f"{r['entity']}: {r['error']}" for r in found))


def coverage(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(key, error) of keys missing from actual or beyond expected."""
    a, b = expected.select(*key).distinct(), actual.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("error", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("error", F.lit("extra")))


def grid_coverage(equations: DataFrame, relations: DataFrame) -> DataFrame:
    """coverage() of all ordered pairs of a paper's different equations: (paper_id, src, dst, error).

    The pairs of a src are compared as one list with those that are told, so no row for a pair meets another in a join.
    """
    pair = ["paper_id", "src", "dst"]
    ids = equations.select("paper_id", F.col("equation_id").alias("src")).dropna().distinct()
    wanted = ids.join(ids.groupBy("paper_id").agg(F.collect_list("src").alias("_all")), "paper_id").select("paper_id", "src", F.array_remove("_all", F.col("src")).alias("_all"))
    told = relations.select(*pair).dropna().groupBy("paper_id", "src").agg(F.collect_set("dst").alias("_told"))
    both = wanted.join(told, ["paper_id", "src"], "full_outer")
    none = F.array().cast(wanted.schema["_all"].dataType)
    a, b = F.coalesce("_all", none), F.coalesce("_told", none)
    named = lambda found, error: F.transform(found, lambda d: F.struct(d.alias("dst"), F.lit(error).alias("error")))
    found = both.select("paper_id", "src", F.inline(F.concat(named(F.array_except(a, b), "missing"), named(F.array_except(b, a), "extra"))))
    unknown = relations.select(*pair).filter("paper_id is null or src is null or dst is null").distinct().withColumn("error", F.lit("extra"))
    return found.unionByName(unknown)


def chunk_errors(chunks: DataFrame, paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Unique ids, known paragraphs and sentences, no empty text (V1)."""
    each = lambda c: chunks.select("paper_id", "chunk_id", F.explode(f"{c}s").alias(c))
    return gather(
        not_unique(chunks, ["paper_id", "chunk_id"], F.col("chunk_id"), "chunk_id"),
        wrong(chunks, F.coalesce(F.trim("text"), F.lit("")) == "", F.col("chunk_id"), "empty text"),
        not_found(each("paragraph_id"), ["paper_id", "paragraph_id"], paragraphs, ["paper_id", "paragraph_id"], F.col("chunk_id"), "paragraph_id"),
        not_found(each("sentence_id"), ["paper_id", "sentence_id"], sentences, ["paper_id", "sentence_id"], F.col("chunk_id"), "sentence_id"),
    )


def document_errors(sections: DataFrame, paragraphs: DataFrame, sentences: DataFrame, references: DataFrame) -> DataFrame:
    """Unique ids, parents that exist, sentence offsets that cut the sentence out of its paragraph, references attached."""
    own = paragraphs.select("paper_id", "paragraph_id", F.col("text").alias("_paragraph"))
    cut = sentences.join(own, ["paper_id", "paragraph_id"])
    return gather(
        not_unique(sections, ["paper_id", "section_id"], F.col("section_id"), "section_id"),
        not_unique(paragraphs, ["paper_id", "paragraph_id"], F.col("paragraph_id"), "paragraph_id"),
        not_unique(sentences, ["paper_id", "sentence_id"], F.col("sentence_id"), "sentence_id"),
        not_found(sections.withColumnRenamed("parent_section_id", "_parent"), ["paper_id", "_parent"], sections, ["paper_id", "section_id"], F.col("section_id"), "parent section"),
        not_found(paragraphs, ["paper_id", "section_id"], sections, ["paper_id", "section_id"], F.col("paragraph_id"), "section"),
        not_found(sentences, ["paper_id", "paragraph_id"], paragraphs, ["paper_id", "paragraph_id"], F.col("sentence_id"), "paragraph"),
        wrong(cut, F.substring("_paragraph", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), F.col("sentence_id"), "offsets do not give the text"),
        not_found(references, ["paper_id", "source_sentence_id"], sentences, ["paper_id", "sentence_id"], F.col("reference_id"), "sentence"),
    )


def relation_errors(equations: DataFrame, relations: DataFrame) -> DataFrame:
    """Every ordered pair of a paper's equations once; known grades; no description with grade none (V3)."""
    key = ["paper_id", "src", "dst"]
    pair = F.concat_ws(" -> ", "src", "dst")
    return gather(
        grid_coverage(equations, relations).select(pair.alias("entity"), "error"),
        not_unique(relations, key, pair, "relation"),
        wrong(relations, ~F.col("grade").isin("strong", "potential", "none"), pair, "unknown grade"),
        wrong(relations, (F.col("grade") == "none") & ~F.col("description").isin("", "none"), pair, "description without a relation"),
    )


def require_label(label: str, known: tuple[str, ...]) -> str:
    """The label, if it is known (V6)."""
    if label not in known:
        raise ValidationError(f"unknown relation label: {label}")
    return label
