"""Choosing rows: deduplication, deterministic splits and samples, priority cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_priority(rows: DataFrame, key: Column, priority: str, position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, that of the highest priority (earliest among equals), in the slot of the key's first row."""
    named = rows.withColumn("_key", key)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(priority), -F.col(position)))
    return named.groupBy(*by, "_key").agg(best.alias("_best"), F.min(position).alias("slot")).select("_best.*", "slot")


def dedupe_first(rows: DataFrame, key: Column, position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key."""
    named = rows.withColumn("_key", key)
    return named.groupBy(*by, "_key").agg(F.min_by(F.struct(*rows.columns), F.col(position)).alias("_first")).select("_first.*")


def hash_split(groups: DataFrame, key: str, seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Add `split`, by rank of sha256(seed:key): train, validation, test.

    Bounds are rounded half to even; the validation bound leaves at least one group for test. Ranking all keys takes
    an order over all of them: keys are dealt in ranges of their digest, and the ranges' sizes give the offsets.
    """
    spark = groups.sparkSession
    keyed = groups.select(key).distinct().withColumn("_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    keyed = keyed.withColumn("_slot", F.substring("_digest", 1, 2))
    sizes = sorted((r["_slot"], r["count"]) for r in keyed.groupBy("_slot").count().collect())  # 256 rows at most
    total, offsets = 0, []
    for slot, n in sizes:
        offsets.append((slot, total))
        total += n
    to_train = round(total * train)
    to_validation = min(total - 1, to_train + max(1, round(total * validation))) if total else 0
    first = F.broadcast(spark.createDataFrame(offsets, "_slot string, _first long"))
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_digest")) - 1
    ranked = keyed.withColumn("_rank", rank).join(first, "_slot").withColumn("rank", F.col("_rank") + F.col("_first"))
    split = F.when(F.col("rank") < to_train, "train").when(F.col("rank") < to_validation, "validation").otherwise("test")
    return ranked.select(key, split.alias("split"))


def stratified_sample(rows: DataFrame, stratum: str, key: Column, per_stratum: int = 25) -> DataFrame:
    """The per_stratum rows of least sha256(key) in each stratum."""
    ranked = rows.withColumn("digest", F.sha2(key.cast("string"), 256))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("digest"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= per_stratum)


def priority_cascade(left: DataFrame, left_key: str, steps: list[tuple[str, DataFrame, Column | list[tuple[Column, str]]]], target: str) -> DataFrame:
    """Resolve each left row by the first step with exactly one distinct target.

    A step is (method, candidates, condition); candidates has `target`, and the condition joins it to left. Equal keys
    are best given as a list of (left expression, candidates' column): then the candidates of a key become one row
    before they meet left, so that many of them cost no pairs. A step that finds several targets, or none, leaves the
    row to the next; `match_method` is unresolved if none decides.
    """
    out = left
    for k, (_, candidates, condition) in enumerate(steps):
        if isinstance(condition, list):
            least = candidates.groupBy(*[F.col(c).alias(f"_c{i}") for i, (_, c) in enumerate(condition)]).agg(F.min(target).alias("_low"), F.max(target).alias("_high"))
            asked = left.select(F.col(left_key).alias("_key"), *[e.alias(f"_c{i}") for i, (e, _) in enumerate(condition)])
            pairs = asked.join(least, [f"_c{i}" for i in range(len(condition))])
        else:
            pairs = left.join(candidates, condition).select(left[left_key].alias("_key"), F.col(target).alias("_low"), F.col(target).alias("_high"))
        found = pairs.groupBy("_key").agg(F.min("_low").alias(f"_t{k}"), F.max("_high").alias("_high")).filter(F.col(f"_t{k}") == F.col("_high")).drop("_high")
        out = out.join(found, out[left_key] == F.col("_key"), "left").drop("_key")
    targets = [F.col(f"_t{k}") for k in range(len(steps))]
    method = F.coalesce(*[F.when(t.isNotNull(), name) for t, (name, _, _) in zip(targets, steps, strict=True)], F.lit("unresolved"))
    return out.withColumn(target, F.coalesce(*targets)).withColumn("match_method", method).drop(*[f"_t{k}" for k in range(len(steps))])
