"""Overlapping views of papers as retrieval chunks, six kinds with one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import html


def _chunk(rows: DataFrame, kind: str, key: Column, order: Column, text: Column, anchor: Column | None = None, labels: Column | None = None) -> DataFrame:
    """The common columns; ids of the parts are null where a kind has none."""
    ids = [F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("section_id", "paragraph_id", "sentence_id", "raw_equation_id", "reference_id")]
    return rows.select(
        F.concat_ws(":", F.col("paper_id").cast("string"), F.lit(kind), key).alias("chunk_id"), F.lit(kind).alias("chunk_type"), "paper_id", *[i.alias(n) for i, n in zip(ids, ("section_id", "paragraph_id", "sentence_id", "raw_equation_id", "reference_id"), strict=True)],
        (F.lit(None).cast("string") if anchor is None else anchor).alias("raw_equation_anchor"), order.alias("document_order"), F.coalesce("section_title", F.lit("")).alias("section_title"), text.alias("text"),
        (F.array().cast("array<string>") if labels is None else labels).alias("visible_equation_labels"),
    )


FIRST_KINDS = ("sentence", "paragraph", "section_aware", "equation_neighborhood")


def build_first_chunks(sections: DataFrame, paragraphs: DataFrame, equations: DataFrame) -> DataFrame:
    """The first generation's section and neighbourhood chunks: paper_id, chunk_id, chunk_type, text, section_id, paragraph_ids, nearby_equation_ids.

    sections: paper_id, section_id, title. paragraphs: paper_id, paragraph_id, section_id, text. equations: paper_id,
    equation_id, latex, section_id, previous_paragraph_id, next_paragraph_id. A paragraph's chunk begins with its
    section's title; an equation's has the title, the paragraph before, the equation and the paragraph after, a line
    each, without those that are missing. Titles are null-safe (P3).
    """
    titles = sections.select("paper_id", "section_id", F.coalesce("title", F.lit("")).alias("_title"))
    head = F.when(F.coalesce("_title", F.lit("")) != "", F.concat(F.lit("Section: "), F.col("_title")))
    sides = F.array_distinct(F.filter(F.array("previous_paragraph_id", "next_paragraph_id"), lambda p: p.isNotNull()))
    ends = equations.select("paper_id", "equation_id", F.explode(sides).alias("paragraph_id"))
    near = ends.groupBy("paper_id", "paragraph_id").agg(F.array_sort(F.collect_set("equation_id")).alias("_near"))
    none = F.array().cast("array<string>")
    ids = lambda kind, key: F.concat_ws(":", F.col("paper_id").cast("string"), F.lit(kind), key)
    titled = paragraphs.join(titles, ["paper_id", "section_id"], "left").join(near, ["paper_id", "paragraph_id"], "left")
    aware = titled.select("paper_id", ids("section_aware", F.col("paragraph_id")).alias("chunk_id"), F.lit("section_aware").alias("chunk_type"), F.concat_ws("\n", head, "text").alias("text"), "section_id", F.array("paragraph_id").alias("paragraph_ids"), F.coalesce("_near", none).alias("nearby_equation_ids"))
    side = lambda column, name: paragraphs.select("paper_id", F.col("paragraph_id").alias(column), F.col("text").alias(name))
    shared = ends.join(near, ["paper_id", "paragraph_id"]).groupBy("paper_id", "equation_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "_near"))), lambda x: x["_near"]))).alias("_near"))
    around = equations.withColumn("paragraph_ids", sides).join(titles, ["paper_id", "section_id"], "left").join(side("previous_paragraph_id", "_before"), ["paper_id", "previous_paragraph_id"], "left").join(side("next_paragraph_id", "_after"), ["paper_id", "next_paragraph_id"], "left").join(shared, ["paper_id", "equation_id"], "left")
    line = F.concat(F.lit("Equation ("), F.col("equation_id"), F.lit("): "), F.coalesce("latex", F.lit("")))
    near_equations = F.array_distinct(F.concat(F.array("equation_id"), F.coalesce("_near", none)))
    by_equation = around.select("paper_id", ids("equation_neighborhood", F.col("equation_id")).alias("chunk_id"), F.lit("equation_neighborhood").alias("chunk_type"), F.concat_ws("\n", head, "_before", line, "_after").alias("text"), "section_id", "paragraph_ids", near_equations.alias("nearby_equation_ids"))
    return aware.unionByName(by_equation)


def build_chunks(parsed: DataFrame) -> DataFrame:
    """All chunks of parsed pages. `parsed` is read several times: write it first."""
    titles = html.sections(parsed).select("paper_id", "section_id", F.col("title").alias("section_title"))
    titled = lambda rows: rows.join(titles, ["paper_id", "section_id"], "left")
    sents, paras, eqs = html.sentences(parsed), html.paragraphs(parsed), html.equations(parsed)
    order, text = F.col("document_order"), F.col("text")
    by_section = paras.groupBy("paper_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("document_order", "text"))).alias("_p"), F.min("document_order").alias("document_order"))
    context = html.equation_contexts(eqs, sents)
    joined = F.concat_ws(" ", F.transform("before", lambda s: s["text"]), F.concat(F.lit("[EQUATION: "), F.col("latex"), F.lit("]")), F.transform("after", lambda s: s["text"]))
    refs = html.cross_references(sents).withColumnsRenamed({"source_section_id": "section_id", "source_paragraph_id": "paragraph_id", "source_sentence_id": "sentence_id"})
    views = [
        _chunk(titled(sents), "sentence", F.col("sentence_id"), order, text),
        _chunk(titled(paras), "paragraph", F.col("paragraph_id"), order, text),
        _chunk(titled(by_section), "section_context", F.col("section_id"), order, F.concat_ws("\n\n", F.transform("_p", lambda x: x["text"]))),
        _chunk(titled(eqs), "raw_equation", F.col("raw_equation_id"), order, F.col("latex"), F.col("anchor_id"), F.col("visible_labels")),
        _chunk(titled(context), "raw_equation_neighborhood", F.col("raw_equation_id"), order, joined, F.col("anchor_id"), F.col("visible_labels")),
        _chunk(titled(refs), "cross_reference", F.col("reference_id"), order, F.col("sentence"), labels=F.col("targets")),
    ]
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view)
    return out
