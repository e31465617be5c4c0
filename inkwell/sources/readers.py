"""Scans of paper lists, component directories, vectors, HTML directories (SRC1-SRC11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.ordering import running_totals
from inkwell.operators.validate import ValidationError, coverage, require


def paper_list(spark: SparkSession, path: str, limit: int | None = 100) -> DataFrame:
    """(position, paper_id): lines without the arXiv prefix, blanks dropped, the first `limit` (SRC1).

    The file is one list, read whole as one row, so that lines keep their order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    named = lines.select("position", F.trim(F.regexp_replace(F.trim("line"), "^arXiv:", "")).alias("paper_id")).filter("paper_id <> ''")
    return named.orderBy("position").limit(limit) if limit else named


def ordered_papers(papers: DataFrame, expected: DataFrame) -> DataFrame:
    """The papers expected, by first position; raises if one is not in the list (SRC2)."""
    firsts = papers.groupBy("paper_id").agg(F.min("position").alias("position")).join(expected.select("paper_id").distinct(), "paper_id", "left_semi")
    require(coverage(expected, firsts, ["paper_id"]).select(F.col("paper_id").alias("entity"), "error"))
    return running_totals(firsts, [F.col("position")], _at=F.lit(1)).select(F.col("_at").cast("int").alias("position"), "paper_id")


def paper_subset(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the papers wanted; raises if one of these has none (F16)."""
    ids = wanted.select("paper_id").distinct()
    unknown = ids.join(rows.select("paper_id").distinct(), "paper_id", "left_anti")
    require(unknown.select(F.col("paper_id").cast("string").alias("entity"), F.lit("unknown paper").alias("error")))
    return rows.join(ids, "paper_id", "left_semi")


def html_directory(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, html) of the *.html files of a directory (SRC5)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("paper_id"), F.col("value").alias("html"))


def component_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one object for each paper, whose name must be their paper_id (SRC7)."""
    rows = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json").withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    wrong = rows.filter(~F.col("paper_id").eqNullSafe(F.col("_stem"))).select(F.col("_stem").alias("entity"), F.lit("file name is not the paper_id").alias("error"))
    require(wrong)
    return rows.drop("_stem")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, equation_id, equation) from one JSON object of papers, each of equations; papers may be empty (SRC6)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,struct<equation:string>>>").alias("m"))
    return whole.select(F.explode("m").alias("paper_id", "e")).select("paper_id", F.explode_outer("e").alias("equation_id", "v")).select("paper_id", "equation_id", "v.equation")


def chunk_table(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("sentence", "section_context", "raw_equation_neighborhood")) -> DataFrame:
    """Chunks of some kinds, by default those that answer questions; the filter reaches the Parquet scan (SRC11, F2).

    Chunks of the first generation have the kinds of chunks.FIRST_KINDS.
    """
    return spark.read.parquet(path).filter(F.col("chunk_type").isin(*kinds))


def vector_table(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """Vectors with their metadata; with `size`, raises if one has another length (SRC8)."""
    rows = spark.read.parquet(path)
    if size is not None and not rows.filter(F.size("embedding") != size).isEmpty():
        raise ValidationError(f"a vector does not have {size} numbers")
    return rows
