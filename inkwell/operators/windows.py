"""Windows of text around equations as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.windows import MARKER
from inkwell.operators.validate import require, wrong

# What stands for an equation and for references to it and to others.
PLURAL = r"(?i)\bEq(?:uation)?s\.?\s*\(\s*[^)]*?\s*\)"
ANY = r"(?i)\bEq(?:uation)?\.?\s*\(\s*[^)]*?\s*\)"


def equation_windows(rows: DataFrame, check: bool = True) -> DataFrame:
    """Add `told` to rows (paper_id, equation_id, equation, window): the marker gives way to the marked equation, and
    references to it and to others are told apart (O1). With `check`, raises unless each window has one marker."""
    markers = F.size(F.split("window", r"\Q" + MARKER + r"\E")) - 1
    if check:
        require(wrong(rows, markers != 1, F.concat_ws("/", "paper_id", "equation_id"), f"needs one {MARKER}"))
    own = F.concat(F.lit(r"(?i)\bEq(?:uation)?\.?\s*\(\s*\Q"), F.col("equation_id"), F.lit(r"\E\s*\)"))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace("window", F.lit(PLURAL), F.lit("<other_eqref>")), own, F.lit("<eqref>")), F.lit(ANY), F.lit("<other_eqref>"))
    return rows.withColumn("told", F.replace(said, F.lit(MARKER), F.concat(F.lit("<starteqn> "), F.col("equation"), F.lit(" <endeqn>"))))


def entity_spans(tags: DataFrame, texts: DataFrame, name: str = "EQ_NAME") -> DataFrame:
    """(text_id, start, end, span) of B- and I- tags: an I- tag goes on with what ends before it, white space between (O3).

    tags: text_id, start, end, entity. texts: text_id, text. Gaps and islands by offsets: a tag that goes on has no gap.
    """
    kept = tags.filter(F.col("entity").isin(f"B-{name}", f"I-{name}")).join(texts, "text_id")
    over = Window.partitionBy("text_id").orderBy("start", "end")
    previous = F.lag("end").over(over)
    gap = F.substring("text", previous + 1, F.col("start") - previous)
    goes_on = (F.col("entity") == f"I-{name}") & previous.isNotNull() & (F.trim(F.regexp_replace(gap, r"\s", " ")) == "")
    islands = kept.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(over))
    spans = islands.groupBy("text_id", "_island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.first("text").alias("text"))
    raw = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    left, right = F.length(F.regexp_extract(raw, r"^\s*", 0)), F.length(F.regexp_extract(raw, r"\s*$", 0))
    trimmed = spans.select("text_id", (F.col("start") + left).cast("int").alias("start"), (F.col("end") - right).cast("int").alias("end"), "text").filter("start < end")
    return trimmed.select("text_id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))


def answer_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """exact_match, answer_precision, answer_recall and no_answer_accuracy: one row.

    gold: paper_id, equation_id, meaning, has_answer; predicted: the same key and meaning. No prediction is an empty one.
    """
    rows = gold.join(predicted.select("paper_id", "equation_id", F.col("meaning").alias("_p")), ["paper_id", "equation_id"], "left").withColumn("_p", F.coalesce("_p", F.lit("")))
    same = F.col("_p") == F.col("meaning")

    def share(hit: Column, among: Column) -> Column:
        return F.coalesce(F.round(F.count_if(hit & among) / F.nullif(F.count_if(among), F.lit(0)), 6), F.lit(0.0))

    return rows.agg(
        share(same, F.lit(True)).alias("exact_match"), share(same, F.col("_p") != "").alias("answer_precision"),
        share(same, F.col("has_answer")).alias("answer_recall"), share(F.col("_p") == "", ~F.col("has_answer")).alias("no_answer_accuracy"),
    )
