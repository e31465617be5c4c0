"""Joining components to the final nested result, leniently or strictly, and writing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.validate import coverage, gather, grid_coverage, not_unique, require


def nest(rows: DataFrame, by: list[str], key: str, value: Column, name: str, order: Column | None = None) -> DataFrame:
    """One row for each group with a map from key to value, in order.

    Values may be of any type. Maps cannot be compared, so entries with a map are put in order by (order, key) alone;
    others by all they have, which is the same as keys are unique, without calling a function for each comparison.
    """
    entry = F.struct(*([] if order is None else [order.alias("o")]), F.col(key).alias("k"), value.alias("v"))
    listed = F.collect_list(entry)
    place = lambda e: e["k"] if order is None else F.struct(e["o"], e["k"])
    rank = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    plain = "map<" not in rows.select(value.alias("v")).schema["v"].dataType.simpleString()
    ranked = F.array_sort(listed) if plain else F.array_sort(listed, rank)
    pairs = ranked if plain and order is None else F.transform(ranked, lambda e: F.struct(e["k"], e["v"]))
    return rows.groupBy(*by).agg(F.map_from_entries(pairs).alias(name))


def equation_order(equation_id: Column) -> Column:
    """Numbers first and by value, then other ids."""
    digits = F.when(equation_id.rlike(r"^[0-9]+$"), F.ltrim(equation_id, F.lit("0")))
    return F.struct(digits.isNull().alias("a"), F.coalesce(F.length(digits), F.lit(0)).alias("b"), F.coalesce(digits, F.lit("")).alias("c"), equation_id.alias("d"))


def outer_export(equations: DataFrame, meanings: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Every equation with what is known of it: left joins, empty defaults (J10, Q23 second form)."""
    key = ["paper_id", "equation_id"]
    text_map = "map<string,string>"
    relation_type = "map<string,struct<grade:string,description:string>>"
    syms = nest(symbols.filter(F.coalesce("definition", F.lit("")) != ""), key, "symbol", F.col("definition"), "symbols")
    rels = nest(relations.withColumnRenamed("src", "equation_id"), key, "dst", F.struct("grade", "description"), "relations")
    return (
        equations.select(*key, "equation")
        .join(meanings.select(*key, "meaning"), key, "left")
        .join(syms, key, "left")
        .join(rels, key, "left")
        .select(*key, "equation", F.coalesce("meaning", F.lit("")).alias("meaning"), F.coalesce("symbols", F.create_map().cast(text_map)).alias("symbols"), F.coalesce("relations", F.create_map().cast(relation_type)).alias("relations"))
    )


def strict_export(equations: DataFrame, meanings: DataFrame, symbols: DataFrame, relations: DataFrame, papers: DataFrame) -> DataFrame:
    """As outer_export, but every component must cover exactly the equations; raises before anything is returned.

    papers has paper_id and position; papers without equations come out with an empty map.
    """
    key = ["paper_id", "equation_id"]
    ids = F.concat_ws("/", *key)
    named = lambda errors, what: errors.select(F.concat(F.lit(what + " "), ids).alias("entity"), "error")
    require(
        gather(
            not_unique(equations, key, ids, "equation"),
            not_unique(symbols, [*key, "symbol"], F.concat_ws("/", *key, "symbol"), "symbol"),
            named(coverage(equations, meanings, key), "meaning"),
            grid_coverage(equations, relations).select(F.concat_ws("/", "paper_id", "src", "dst").alias("entity"), "error"),
            coverage(papers, equations, ["paper_id"]).filter("error = 'extra'").select(F.col("paper_id").alias("entity"), F.lit("not in the paper list").alias("error")),
        )
    )
    return outer_export(equations, meanings, symbols, relations)


def grouped_reasons(statuses: DataFrame, status: str = "status", paper: str = "paper_id") -> DataFrame:
    """One row for each status: how many papers have it, and which, in order."""
    return statuses.groupBy(status).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(paper)).alias("papers"))


def final_object(exported: DataFrame, papers: DataFrame) -> DataFrame:
    """(position, paper_id, json): one JSON object for each paper of the list, equations in their order, fields fixed (SNK4)."""
    body = F.struct("equation", "meaning", "symbols", "relations")
    nested = nest(exported, ["paper_id"], "equation_id", body, "body", order=equation_order(F.col("equation_id")))
    return papers.join(nested, "paper_id", "left").select("position", "paper_id", F.coalesce(F.to_json("body"), F.lit("{}")).alias("json"))
