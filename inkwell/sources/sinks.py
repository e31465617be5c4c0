"""Writing results: component tables, the final object, reports (SNK1-SNK8)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.validate import ValidationError


def write_component(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One directory for each paper; a file appears when its task is committed (SNK1)."""
    bad = df.filter(~F.col("paper_id").cast("string").rlike(r"^[\w.:-]+$")).limit(1).collect()
    if bad:
        raise ValidationError(f"paper_id cannot name a directory: {bad[0]['paper_id']}")
    df.write.mode("overwrite").partitionBy("paper_id").format(fmt).save(path)


def safe_ids(rows: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """The rows; raises if an id cannot name a file or directory."""
    bad = rows.filter(~F.coalesce(F.col(id_col).cast("string"), F.lit("")).rlike(r"^[\w.:-]+$") | F.col(id_col).cast("string").isin(".", "..")).limit(1).collect()
    if bad:
        raise ValidationError(f"{id_col} cannot name a directory: {bad[0][id_col]}")
    return rows


def write_review_sample(rows: DataFrame, path: str) -> None:
    """Rows for review as JSON lines with empty fields for the reviewer, in a file for each paper (SNK7)."""
    ready = safe_ids(rows).withColumns({"gold_relation": F.lit("").cast("string"), "reviewer_note": F.lit("").cast("string")})
    publish(ready, path, lambda d, p: d.write.partitionBy("paper_id").json(p))


def write_vectors(vectors: DataFrame, path: str, model: str, pooling: str = "attention_mask_mean") -> None:
    """Vectors with what made them: Parquet by paper, and a table of model, pooling, size and rows beside it (SNK2)."""
    sizes = [r["n"] for r in vectors.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValidationError("vectors differ in size")
    publish(safe_ids(vectors), f"{path}/vectors", lambda d, p: d.write.partitionBy("paper_id").parquet(p))
    told = vectors.groupBy("paper_id").agg(F.count("*").alias("rows")).withColumns({"model": F.lit(model), "pooling": F.lit(pooling), "normalized": F.lit(True), "dimension": F.lit(sizes[0] if sizes else 0)})
    publish(told, f"{path}/metadata", lambda d, p: d.write.json(p))


def write_postprocessed(rows: DataFrame, source: str, target: str) -> None:
    """Cleaned records beside their source, never in its place (K7)."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the output must be another directory than the input")
    publish(safe_ids(rows), target, lambda d, p: d.write.partitionBy("paper_id").parquet(p))


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write beside the target, then put it in its place; the old result stays until then, and if writing fails (SNK3)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    stem = path.rstrip("/")
    new, old, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{stem}.new", f"{stem}.old", stem))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    (write or (lambda d, p: d.write.parquet(p)))(df, f"{stem}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not publish {path}")
    fs.delete(old, True)


def write_final(objects: DataFrame, path: str) -> None:
    """One JSON object over all papers in order, one paper on a line; nothing is replaced if writing fails (SNK4).

    `objects` is (position, paper_id, json). The rows are sorted over partitions and written as text parts, the
    braces and commas coming with the rows, so no task sees them all; concatenated in order the parts are the object.
    """
    last = objects.agg(F.max("position")).first()[0]
    open_, close = F.when(F.col("position") == F.lit(0), "{").otherwise(""), F.when(F.col("position") == F.lit(last), "}").otherwise(",")
    line = F.concat(open_, F.to_json(F.struct(F.col("paper_id").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("paper_id").alias("k")))) - 6), F.lit(":"), F.col("json"), close)
    publish(objects.repartitionByRange("position").sortWithinPartitions("position").select(line.alias("value")), path, lambda d, p: d.write.text(p))


class RunReport:
    """Seconds and rows of each stage (SNK5)."""

    def __init__(self) -> None:
        self.stages: list[dict] = []

    def run(self, name: str, stage: Callable[[], DataFrame]) -> DataFrame:
        began = time.time()
        out = stage()
        self.stages.append({"stage": name, "seconds": round(time.time() - began, 3), "rows": out.count()})
        return out

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(s),) for s in self.stages], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_table(rows: Iterable, columns: list[str]) -> str:
    """A small aggregate as a Markdown table; bars and line ends in cells are escaped (SNK6, X25)."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *[[cell(r[c]) for c in columns] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def ranked_json(df: DataFrame) -> list[str]:
    """The rows of a small ranked result as JSON strings, in rank order (SNK8)."""
    return [r["json"] for r in df.orderBy("rank").select(F.to_json(F.struct(*df.columns)).alias("json")).collect()]
