"""Connected components of a graph whose links are a DataFrame, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.scratch import Scope, materialize


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour, or to the node if that is less."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are linked to the least of them."""
    low = edges.join(_nearest(edges), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.union(_nearest(edges).withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for `edges` (u, v) with u <> v: every node but the least of its component, and that least one.

    Degrees may be as skewed as they like: minima are combined before the shuffle and joins are equi-joins. The
    rounds needed grow with the logarithm of the number of nodes; each round is written and read back.
    """
    with Scope() as scope:
        edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
        before = None
        while True:
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before or not state[0]:
                return scope.keep(edges)
            before, old = state, edges
            edges = materialize(_small_star(_large_star(edges)), "links")
            scope.drop(old)
