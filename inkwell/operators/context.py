"""Neighbourhoods in order: as-of neighbours, nearest rows, cut-offs, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_neighbours(points: DataFrame, items: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """For each point the last item strictly before it and the first strictly after, by an integer order.

    Both sides are put in one table and two running windows go over it, one in the order and one in the reverse, so the
    cost is two sorts, not a range join; neither frame looks ahead.
    Items that share the order are neither before nor after; of several at the nearest order, before takes the
    greatest and after the least value.
    """
    names = [*by, order]
    a = points.select("*", F.lit(None).cast(items.schema[value].dataType).alias("_item"))
    b = items.select(*names, F.col(value).alias("_item"))
    both = a.unionByName(b.withColumn("_is_item", F.lit(True)), allowMissingColumns=True)
    over = Window.partitionBy(*by).orderBy(order)
    before = F.max(F.when(F.col("_item").isNotNull(), F.struct(F.col(order), F.col("_item")))).over(over.rangeBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*by).orderBy(-F.col(order)).rangeBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(F.col("_item").isNotNull(), F.struct(F.col(order), F.col("_item")))).over(back)
    out = both.withColumn("previous", before["_item"]).withColumn("next", after["_item"])
    return out.filter("_is_item is null").drop("_is_item", "_item")


def nearest_rows(rows: DataFrame, by: list[str], order: str, value: str, n: int = 5) -> DataFrame:
    """Add `before` and `after`: up to n values on either side in order, nearest last and nearest first."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("before", F.collect_list(value).over(w.rowsBetween(-n, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, n)))


def rank_distance(rows: DataFrame, by: list[str], place: list[str | Column], walk: list[str | Column]) -> DataFrame:
    """Add `distance`: how far apart in the order `place` a row and the one before it in the order `walk` are."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*place)))
    step = F.abs(F.col("_place") - F.lag("_place").over(Window.partitionBy(*by).orderBy(*walk)))
    return ranked.withColumn("distance", step).drop("_place")


def joined_in_order(rows: DataFrame, by: list[str], order: str, text: str, separator: str = "\n") -> DataFrame:
    """One row for each group: its texts joined in order, and the least order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.concat_ws(separator, F.transform(listed, lambda x: x["t"])).alias("text"), F.min(order).alias("first"))


def first_n(rows: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("ordinal") <= n)


def running_cutoff(groups: DataFrame, size: str, target: float, order: list[str], by: list[str]) -> DataFrame:
    """Groups in order while the sizes before them stay below target; the one that crosses it is kept."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("before_total", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("before_total") < target)


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_order: str, right_order: str, width: int) -> DataFrame:
    """Pairs that agree on `on` and whose orders differ by less than width.

    The orders are cut in bands of that width and rows meet those of the same band and its two neighbours, so a key
    with many rows is joined band by band.
    """
    band = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("_band", F.explode(F.array(*[band(left_order) + d for d in (-1, 0, 1)])))
    return a.join(right.withColumn("_band", band(right_order)), [*on, "_band"]).filter(F.abs(F.col(left_order) - F.col(right_order)) < width).drop("_band")


def merge_open_brackets(parts: Column) -> Column:
    """Join array members until as many ) as ( were seen, starting afresh after each merge."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        text = F.when(acc["buf"] == "", s).otherwise(F.concat(acc["buf"], F.lit(" "), s))
        done = count(text, "(") <= count(text, ")")
        return F.struct(F.when(done, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"), F.when(done, F.lit("")).otherwise(text).alias("buf"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))))


def parents_by_level(sections: DataFrame, by: list[str], order: str, level: str, key: str) -> DataFrame:
    """Add `parent`: the nearest earlier row of a smaller level, at any depth.

    A document's rows, which one array holds, pass over a stack of the rows that are still open: a row closes those of
    its own level and deeper, and the one then on top is its parent.
    """
    item = F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.col(key).alias("k"))
    grouped = sections.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    kind = sections.schema
    entry = f"struct<o:{kind[order].dataType.simpleString()},l:{kind[level].dataType.simpleString()},k:{kind[key].dataType.simpleString()}>"
    found = f"struct<o:{kind[order].dataType.simpleString()},k:{kind[key].dataType.simpleString()},parent:{kind[key].dataType.simpleString()}>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast(f"array<{found}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        still = F.filter(acc["open"], lambda s: s["l"] < x["l"])
        parent = F.get(F.slice(still, -1, 1), F.lit(0))["k"]
        return F.struct(F.concat(F.when(F.size(still) > 0, still).otherwise(F.array().cast(f"array<{entry}>")), F.array(x)).alias("open"), F.concat(acc["out"], F.array(F.struct(x["o"], x["k"], parent.alias("parent")).cast(found))).alias("out"))

    parents = grouped.select(*by, F.explode(F.aggregate("_rows", start, step, lambda acc: acc["out"])).alias("_p"))
    named = parents.select(*by, F.col("_p.o").alias(order), F.col("_p.k").alias("_key"), F.col("_p.parent").alias("parent"))
    return sections.join(named, [*by, order]).filter(F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
