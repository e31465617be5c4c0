"""Which equation table of a page an entry of the corpus is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.latex import canonical_latex


@F.pandas_udf(T.StringType())
def normal_latex(s: pd.Series) -> pd.Series:
    """LaTeX in its normal form (X3); empty for null."""
    return s.map(lambda x: canonical_latex(x or ""))


def annotation_ids(annotations: Column) -> Column:
    """The id of the first annotation element of each piece of HTML, each once, in order."""
    tag = lambda h: F.regexp_extract(h, r"(?is)<annotation\b([^>]*)>", 1)
    name = lambda h: F.regexp_extract(tag(h), r"""(?is)(?:^|\s)id\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.array_distinct(F.filter(F.transform(F.coalesce(annotations, F.array().cast("array<string>")), name), lambda x: x != ""))


def context_audit(trail: Column) -> Column:
    """The last entry of an audit trail (array of structs) that tells of the context's extraction."""
    return F.get(F.slice(F.filter(trail, lambda e: e["context_extraction"].isNotNull()), -1, 1), F.lit(0))["context_extraction"]


def resolve(entries: DataFrame, tables: DataFrame) -> DataFrame:
    """Add table_id and match_method to entries: the first step with an answer decides, else `unresolved` with null.

    entries: paper_id, equation_id, equation (LaTeX), annotation_ids (array, the audit's id last), audit_anchor_id.
    tables: paper_id, table_id, document_order, dom_ids (of the table and all that is in it), labels, forms (normal
    LaTeX). The steps: the first annotation id within a table; the audit's anchor; the only table with the label; of
    several with it the only one with the LaTeX; the only table with the LaTeX. An id that several elements bear is
    that of the first in the document, the smallest table_id among equal places; tables without a place have no ids.
    An entry without an equation_id has no label.
    """
    key = ["paper_id", "equation_id"]
    first = F.min_by("table_id", F.struct("document_order", "table_id"))
    dom = tables.filter("document_order is not null").select("paper_id", "table_id", "document_order", F.explode("dom_ids").alias("dom_id")).groupBy("paper_id", "dom_id").agg(first.alias("table_id"))
    named = tables.select("paper_id", "table_id", F.explode(F.array_distinct("labels")).alias("equation_id"))
    formed = tables.select("paper_id", "table_id", F.explode(F.array_distinct("forms")).alias("latex")).filter("latex <> ''")
    own = entries.select(*key, normal_latex("equation").alias("latex")).filter("latex <> ''")

    asked = entries.select(*key, F.posexplode("annotation_ids").alias("_k", "dom_id"))
    by_annotation = asked.join(dom, ["paper_id", "dom_id"]).groupBy(*key).agg(F.min_by("table_id", "_k").alias("_t0"))
    by_anchor = entries.select(*key, F.col("audit_anchor_id").alias("dom_id")).join(dom, ["paper_id", "dom_id"]).select(*key, F.col("table_id").alias("_t1"))
    only = lambda rows, name: rows.groupBy(*key).agg(F.count_distinct("table_id").alias("_n"), F.min("table_id").alias(name)).filter("_n = 1").drop("_n")
    labelled = entries.select(*key).join(named, key)
    exact = own.join(formed, ["paper_id", "latex"]).select(*key, "table_id")
    steps = [by_annotation, by_anchor, only(labelled, "_t2"), only(labelled.join(exact, [*key, "table_id"]), "_t3"), only(exact, "_t4")]
    out = entries
    for step in steps:
        found = step.withColumnsRenamed({"paper_id": "_paper", "equation_id": "_equation"})
        out = out.join(found, (F.col("paper_id") == F.col("_paper")) & F.col("equation_id").eqNullSafe(F.col("_equation")), "left").drop("_paper", "_equation")
    methods = ("annotation_id", "audit_anchor_id", "visible_label", "visible_label_and_latex", "exact_latex")
    columns = [f"_t{k}" for k in range(len(steps))]
    method = F.coalesce(*[F.when(F.col(c).isNotNull(), m) for c, m in zip(columns, methods, strict=True)], F.lit("unresolved"))
    return out.withColumn("table_id", F.coalesce(*columns)).withColumn("match_method", method).drop(*columns)
