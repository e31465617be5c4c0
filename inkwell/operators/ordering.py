"""Order over all rows of a table: running sums and row numbers with no task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.scratch import materialize


def running_totals(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Add each of `sums` over all earlier rows in the order.

    Rows are dealt in ranges of the order and summed within; the ranges' own totals, one row each, give the offsets.
    The order must tell rows apart, or equal rows get any of their places.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({f"_o{k}": c for k, c in enumerate(order)} | {f"_s_{n}": c for n, c in sums.items()})
    names = [f"_o{k}" for k in range(len(order))]
    ranged = materialize(keyed.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = sorted(ranged.groupBy("_range").agg(*[F.sum(f"_s_{n}").alias(n) for n in sums]).collect(), key=lambda r: r["_range"])
    offsets, seen = [], dict.fromkeys(sums, 0)
    for r in totals:
        offsets.append((r["_range"], *seen.values()))
        seen = {n: seen[n] + (r[n] or 0) for n in sums}
    kinds = {n: ranged.schema[f"_s_{n}"].dataType.simpleString() for n in sums}
    first = F.broadcast(spark.createDataFrame([(r, *[float(v) if kinds[n] == "double" else v for n, v in zip(sums, vs, strict=True)]) for r, *vs in offsets], "_range int, " + ", ".join(f"_b_{n} {'double' if kinds[n] == 'double' else 'long'}" for n in sums)))
    before = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({n: F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in sums})
    return summed.join(first, "_range").withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_range", *names, *[f"_s_{n}" for n in sums], *[f"_b_{n}" for n in sums])
