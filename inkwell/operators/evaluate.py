"""Classifier evaluation, calibration and rejection reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.ordering import running_totals

ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def label_metrics(rows: DataFrame, gold: str = "gold_label", predicted: str = "predicted_label") -> DataFrame:
    """precision, recall, f1 and support of each label found in gold or prediction."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("t")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("hits"))
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return sums.select("label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")), 6).alias("f1"), "support")


def overall_metrics(rows: DataFrame, gold: str = "gold_label", predicted: str = "predicted_label") -> DataFrame:
    """accuracy, macro-F1 over the labels that occur in gold, and the number of rows: one row."""
    macro = label_metrics(rows, gold, predicted).filter("support > 0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    accuracy, n = rows.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("int")), 6), F.count("*")).first()
    return macro.select(F.lit(accuracy).cast("double").alias("accuracy"), "macro_f1", F.lit(n).cast("long").alias("n"))


def confusion(rows: DataFrame, labels: list, gold: str = "gold_label", predicted: str = "predicted_label") -> DataFrame:
    """One row for each gold label, one column predicted_<label> for each of `labels`."""
    return rows.groupBy(gold).agg(*[F.count_if(F.col(predicted) == x).alias(f"predicted_{x}") for x in labels])


def threshold_sweep(rows: DataFrame, score: str, correct: str, precision: float = 0.9, least: int = 5) -> DataFrame:
    """The threshold of widest coverage among those with the precision and at least `least` accepted rows.

    One row, or none if no threshold qualifies; of equal coverage the higher threshold. Rows are counted by distinct
    score first, so the running sums go over the scores, not the rows, and no task sees them all.
    """
    steps = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("right"))
    summed = running_totals(steps, [-F.col("threshold")], _n=F.col("n"), _good=F.col("right"))
    swept = summed.select("threshold", (F.col("_n") + F.col("n")).alias("accepted"), (F.col("_good") + F.col("right")).alias("good"))
    kept = swept.filter((F.col("good") / F.col("accepted") >= precision) & (F.col("accepted") >= least))
    return kept.orderBy(F.col("accepted").desc(), F.col("threshold").desc()).limit(1).select("threshold", "accepted", F.round(F.col("good") / F.col("accepted"), 6).alias("precision"))


def length_summary(rows: DataFrame, by: str, length: Column) -> DataFrame:
    """Least, median and greatest length of each group, and its rows."""
    return rows.withColumn("_n", length).groupBy(by).agg(F.min("_n").alias("low"), F.median("_n").alias("middle"), F.max("_n").alias("high"), F.count("*").alias("n_docs"))


def accepted_metrics(rows: DataFrame, accepted: Column, correct: Column) -> DataFrame:
    """Precision among accepted rows, coverage and abstention."""
    n, took, good = F.count("*"), F.count_if(accepted), F.count_if(accepted & correct)
    return rows.agg(n.alias("n"), took.alias("accepted"), F.round(ratio(good, took), 6).alias("precision"), F.round(ratio(took, n), 6).alias("coverage"), F.round(1 - ratio(took, n), 6).alias("abstention"))


def accepts(probabilities: Column, none_label: str, threshold: Column | float, margin: Column | float) -> Column:
    """The acceptance gate: the best label is no `none_label`, its probability and lead suffice."""
    best = F.array_max(F.transform(F.map_entries(probabilities), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    rest = F.sort_array(F.map_values(probabilities), asc=False)
    return (best["label"] != none_label) & (best["p"] >= threshold) & (best["p"] - F.coalesce(F.get(rest, F.lit(1)), F.lit(0.0)) >= margin)


def reason_counts(rows: DataFrame, record: str, reasons: str) -> DataFrame:
    """For each reason the candidates and the distinct records that have it; a candidate may have several."""
    return rows.select(record, F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("candidates"), F.count_distinct(record).alias("records"))


def exclusive_reasons(rows: DataFrame, reason: Column) -> DataFrame:
    """Counts and shares, in percent to two places, of one reason for each row."""
    counts = rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    total = rows.count()
    return counts.select("reason", "n", F.round(100.0 * F.col("n") / F.lit(max(1, total)), 2).alias("percent"))


def examples_per_reason(rows: DataFrame, record: str, reasons: str, k: int = 3) -> DataFrame:
    """The first k records of each reason, by record."""
    each = rows.select(record, F.explode(reasons).alias("reason")).distinct()
    return each.withColumn("ordinal", F.row_number().over(Window.partitionBy("reason").orderBy(record))).filter(F.col("ordinal") <= k)


def split_summary(rows: DataFrame, split: str = "split", label: str = "label", paper: str = "paper_id") -> DataFrame:
    """Rows and distinct papers for each split and label."""
    return rows.groupBy(split, label).agg(F.count("*").alias("n"), F.count_distinct(paper).alias("papers"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """1 / count of each label."""
    return rows.groupBy(label).agg(F.round(1 / F.count("*"), 9).alias("weight"))
