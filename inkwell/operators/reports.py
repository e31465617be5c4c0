"""Summaries and reports of runs (A19-A21, K8, X24, SNK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import plural
from inkwell.operators.evaluate import examples_per_reason, exclusive_reasons, reason_counts
from inkwell.sources.sinks import markdown_table


def rejected_meanings(cleaned: DataFrame) -> DataFrame:
    """Flagged records with the reasons of all their candidates (F19): cleaned has c from clean_phrase."""
    flagged = cleaned.filter("c.flagged")
    return flagged.select("paper_id", "equation_id", F.col("c.original_meaning").alias("original_meaning"), F.array_sort(F.array_distinct(F.flatten(F.transform("c.candidates", lambda x: x["reasons"])))).alias("reasons"))


def rejected_symbols(symbols: DataFrame, definitions: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Symbols without a definition and why: no retrieved text names them, or no pattern fits."""
    key = ["paper_id", "equation_id", "canonical"]
    left = symbols.join(definitions, key, "left_anti").join(mentioned.select(*key).distinct().withColumn("_m", F.lit(True)), key, "left")
    return left.select(*key, F.when(F.col("_m"), "no_supported_definition_pattern").otherwise("no_retrieved_alias").alias("reason"))


def postprocessing_report(cleaned: DataFrame, examples: int = 3) -> str:
    """Counts, strategies and overlapping reasons as Markdown; only small aggregates come to the driver."""
    n, flagged, applied = cleaned.agg(F.count("*"), F.count_if("c.flagged"), F.count_if("c.applied")).first()
    strategies = cleaned.groupBy(F.col("c.strategy").alias("strategy")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "strategy")
    each = cleaned.filter("c.flagged").withColumn("record", F.concat_ws("/", "paper_id", "equation_id")).select("record", F.explode("c.candidates").alias("x")).select("record", F.col("x.reasons").alias("reasons"))
    counts = reason_counts(each, "record", "reasons").orderBy(F.col("records").desc(), "reason")
    shown = examples_per_reason(each, "record", "reasons", examples).groupBy("reason").agg(F.concat_ws(", ", F.array_sort(F.collect_list("record"))).alias("examples")).orderBy("reason")
    parts = [f"# Meanings after cleaning\n\n{n} records, {flagged} flagged, {applied} changed."]
    for title, df in (("Strategies", strategies), ("Reasons", counts), ("Examples", shown)):
        parts.append(f"## {title}\n\n{markdown_table(df.collect(), df.columns)}")
    return "\n\n".join(parts) + "\n"


def symbol_report(rejected: DataFrame) -> str:
    counts = exclusive_reasons(rejected, F.col("reason")).orderBy(F.col("n").desc())
    return f"# Symbols without a definition\n\n{markdown_table(counts.collect(), counts.columns)}\n"


def audit_trail(equation_id: Column, n_before: Column, n_after: Column, symbols: Column, n_defined: Column, meaning: Column, source: Column, score: Column, n_relations: Column, n_kept: Column, n_equations: Column, method: Column | None = None) -> Column:
    """What was done for an equation, as a struct of sentences.

    `method` is how the equation was found: null for one that is known from its annotation only, `unresolved` for one
    that no table of the page is.
    """
    method = F.lit("unknown") if method is None else method
    lost = F.coalesce(method == "unresolved", F.lit(False))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    preview = say("Detected ", F.concat_ws(", ", F.slice(symbols, 1, 6)), F.when(F.size(symbols) > 6, say(", and ", plural(F.size(symbols) - 6, "other"))).otherwise(""), " in the equation.")
    chosen = F.when(meaning != "", say("Selected equation meaning from ", source, " evidence with score ", score.cast("string"), ".")).otherwise("No equation-level meaning was selected from the available evidence.")
    lookup = F.when(n_defined > 0, say("Assigned definitions to ", plural(n_defined, "symbol"), " after retrieval-based symbol lookup. ")).when(F.size(symbols) > 0, "No symbol definitions were assigned after retrieval-based symbol lookup. ").otherwise("No symbol definitions were needed because no symbols were detected. ")
    related = say("Built ", plural(n_relations, "relation"), " covering the other ", plural(n_equations - 1, "reviewed equation"), "; ", plural(n_kept, "non-none relation"), " remained after scoring.")
    return F.struct(
        F.when(method.isNull(), say("Found reviewed equation (", equation_id, ") in the annotation data."))
        .when(lost, say("Found reviewed equation (", equation_id, "), but stage04 could not align it to a raw HTML equation."))
        .otherwise(say("Found numbered equation (", equation_id, ") in the source text using ", method, "."))
        .alias("extract_eq"),
        F.when(n_before + n_after > 0, say("Collected ", plural(n_before, "preceding sentence"), " and ", plural(n_after, "following sentence"), " as local context.")).when(lost, "No local context was attached because the equation alignment was unresolved.").otherwise("No nearby context sentences were available for this equation.").alias("extract_context"),
        F.when(F.size(symbols) > 0, preview).otherwise("Detected no symbols in the equation.").alias("find_symbol"),
        F.concat(lookup, chosen).alias("extract_symbol_name"),
        F.when(n_equations > 1, related).otherwise("No relation pairs were needed because this paper has one reviewed equation.").alias("build_relations"),
        F.lit("Confirmed required fields equation, meaning, symbols, relations, and audit-trail are present.").alias("validate_entry"),
    )
