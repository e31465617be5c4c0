"""Functions over arrays: set measures, dot products, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two sets; 0 when both are empty."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / joint)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; the cosine of unit vectors (M1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def min_max(value: Column, over: WindowSpec) -> Column:
    """Position between the group's least and greatest value; 0.5 where they meet."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low <= 1e-8, F.lit(0.5)).otherwise((value - low) / (high - low))


def top_two_margin(probabilities: Column) -> Column:
    """Lead of the greatest value of a map over the second (M5); the value itself if it is alone."""
    ranked = F.sort_array(F.map_values(probabilities), asc=False)
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))


def softmax(values: Column) -> Column:
    """Shares of the exponentials of an array, taken from the greatest so that none overflows (M5)."""
    parts = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def in_order(rows: Column) -> Column:
    """collect_list of struct(ordinal, value) as the values by ordinal, first of equal ones only."""
    return F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["value"]))
