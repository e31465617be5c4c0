"""Sections, references and evidence of papers: ids, order, counts, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.validate import wrong

SYNTHETIC = {"abstract": (0, "Abstract"), "main": (1, "Main matter")}


def unused_ids(rows: DataFrame, by: list[str], order: str, base: str, name: str) -> DataFrame:
    """Add `name`: the base id, or base:2, base:3, ... the first that no earlier row of the group took.

    An id that another row brings itself is taken as well, so the rows of a group, which one array holds, are gone
    through in order. `order` tells the rows of a group apart.
    """
    kind = rows.schema[order].dataType.simpleString()
    found = f"array<struct<o:{kind},id:string>>"
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(base).alias("b")))).alias("_rows"))

    def step(acc: Column, x: Column) -> Column:
        used = F.transform(acc, lambda e: e["id"])
        tried = F.concat(F.array(x["b"]), F.transform(F.sequence(F.lit(2), F.size(acc) + 2), lambda k: F.concat(x["b"], F.lit(":"), k.cast("string"))))
        free = F.get(F.filter(tried, lambda t: ~F.array_contains(used, t)), F.lit(0))
        return F.concat(acc, F.array(F.struct(x["o"].alias("o"), free.alias("id"))))

    named = grouped.select(*by, F.explode(F.aggregate("_rows", F.array().cast(found), step)).alias("_n"))
    return rows.join(named.select(*by, F.col("_n.o").alias(order), F.col("_n.id").alias(name)), [*by, order])


def numbered_ids(rows: DataFrame, by: list[str], order: str, base: str, name: str) -> DataFrame:
    """Add `name`: the base id for its first row in a group, then base:2, base:3, ... by count (W3, paragraphs)."""
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return rows.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit(":"), n.cast("string"))))


def ordered_sections(sections: DataFrame, by: str = "paper_id", position: str = "position", section: str = "section_id") -> DataFrame:
    """Add `order`, from 1, by position and then id; a section without a position comes first."""
    return sections.withColumn("order", F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce(position, F.lit(0)), section)))


def synthetic_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections for paragraphs that have none: one for those of the abstract, one for the rest, where the first stands.

    paragraphs: paper_id, section_id, document_order, in_abstract.
    """
    kind = F.when(F.col("in_abstract"), "abstract").otherwise("main")
    loose = paragraphs.filter("section_id is null").groupBy("paper_id", kind.alias("kind")).agg(F.min("document_order").alias("position"))
    level = F.when(F.col("kind") == "abstract", SYNTHETIC["abstract"][0]).otherwise(SYNTHETIC["main"][0])
    title = F.when(F.col("kind") == "abstract", SYNTHETIC["abstract"][1]).otherwise(SYNTHETIC["main"][1])
    return loose.select("paper_id", F.concat(F.lit("__"), F.col("kind"), F.lit("__")).alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), level.alias("level"), "kind", title.alias("title"), "position", F.lit(True).alias("synthetic"))


def split_labels(references: DataFrame, equations: DataFrame) -> DataFrame:
    """Add `resolved` and `unresolved`: the targets of each reference that are equations of the paper, or not, in order and each once."""
    key = ["paper_id", "targets"]
    known = equations.select("paper_id", F.col("equation_id").alias("_t"), F.lit(True).alias("_is")).distinct()
    lists = references.select(*key).distinct()  # no row is wider than its own targets, however many equations a paper has
    each = lists.select(*key, F.posexplode(F.array_distinct("targets")).alias("_k", "_t")).join(known, ["paper_id", "_t"])
    found = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_f"))
    named = found.select(F.col("paper_id").alias("_paper"), F.col("targets").alias("_targets"), F.transform("_f", lambda x: x["_t"]).alias("_resolved"))
    joined = references.join(named, (F.col("paper_id") == F.col("_paper")) & (F.col("targets") == F.col("_targets")), "left")
    none = F.when(F.col("targets").isNotNull(), F.array().cast("array<string>"))
    resolved = F.coalesce("_resolved", none)
    return joined.withColumn("resolved", resolved).withColumn("unresolved", F.array_except(F.array_distinct("targets"), resolved)).drop("_paper", "_targets", "_resolved")


def paper_totals(papers: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row for each paper with n_<part>, 0 where it has none (A1)."""
    out = papers.select("paper_id").distinct()
    for name, rows in parts.items():
        out = out.join(rows.groupBy("paper_id").agg(F.count("*").alias(f"n_{name}")), "paper_id", "left")
    return out.na.fill(0, [f"n_{name}" for name in parts])


def overall_totals(totals: DataFrame) -> DataFrame:
    """The sums of paper_totals(), and how many papers there are: one row (A1)."""
    names = [c for c in totals.columns if c != "paper_id"]
    return totals.agg(F.count("*").alias("n_papers"), *[F.sum(c).alias(c) for c in names])


def attachment_errors(references: DataFrame, attached: DataFrame, times: int = 2) -> DataFrame:
    """References that are not attached just `times` times, to their sentence and their paragraph."""
    key = ["paper_id", "reference_id"]
    counted = references.select(*key).distinct().join(attached.groupBy(*key).agg(F.count("*").alias("_n")), key, "left")
    return wrong(counted, F.coalesce("_n", F.lit(0)) != times, F.col("reference_id"), f"not attached {times} times")


def equation_records(equations: DataFrame, sentences: DataFrame, n: int = 5) -> DataFrame:
    """Add before_sentences and after_sentences: the first n ids of either side whose sentence is known, with its text.

    equations: paper_id, equation_id, before_sentence_ids, after_sentence_ids and any other columns.
    """
    texts = sentences.select("paper_id", "sentence_id", "text")
    out = equations
    for side in ("before", "after"):
        ids = equations.select("paper_id", "equation_id", F.posexplode(F.slice(f"{side}_sentence_ids", 1, n)).alias("_k", "sentence_id"))
        listed = ids.join(texts, ["paper_id", "sentence_id"]).groupBy("paper_id", "equation_id").agg(F.array_sort(F.collect_list(F.struct("_k", "sentence_id", "text"))).alias("_l"))
        told = listed.select("paper_id", "equation_id", F.transform("_l", lambda x: F.struct(x["sentence_id"].alias("sentence_id"), x["text"].alias("text"))).alias(f"{side}_sentences"))
        none = F.array().cast("array<struct<sentence_id:string,text:string>>")
        out = out.join(told, ["paper_id", "equation_id"], "left").withColumn(f"{side}_sentences", F.coalesce(f"{side}_sentences", none))
    return out


def with_markup(equations: DataFrame, raw: DataFrame) -> DataFrame:
    """Add the MathML of each equation by its raw id, empty where it is unknown."""
    own = raw.select("paper_id", "raw_equation_id", F.col("mathml").alias("_m"))
    joined = equations.drop("mathml").join(own, ["paper_id", "raw_equation_id"], "left")
    return joined.withColumn("mathml", F.coalesce("_m", F.array().cast("array<string>"))).drop("_m")


def equation_evidence(equations: DataFrame, sentences: DataFrame) -> DataFrame:
    """(paper_id, equation_id, sentence_id, section_id, text, position, pos): the sentences of the paragraphs around.

    equations: paper_id, equation_id, document_order, previous_paragraph_id, next_paragraph_id. A next paragraph that
    also comes right before another equation introduces that one; of several equations with one previous paragraph the
    last owns it. A sentence in both paragraphs counts once, in the place of the first and as the second tells it.
    """
    key = ["paper_id", "paragraph_id"]
    owners = equations.filter("previous_paragraph_id is not null").groupBy("paper_id", F.col("previous_paragraph_id").alias("paragraph_id")).agg(F.max_by("equation_id", F.struct("document_order", "equation_id")).alias("_owner"))
    side = lambda c, k, kind: equations.select("paper_id", "equation_id", F.col(c).alias("paragraph_id"), F.lit(k).alias("_side"), F.lit(kind).alias("position"))
    both = side("previous_paragraph_id", 0, "before_equation").unionByName(side("next_paragraph_id", 1, "after_equation")).join(owners, key, "left")
    other = (F.col("_side") == 1) & F.col("_owner").isNotNull() & (F.col("_owner") != F.col("equation_id"))
    told = both.withColumn("position", F.when(other, "introduces_other_equation").otherwise(F.col("position"))).join(sentences.select(*key, "sentence_id", "section_id", "text", F.col("order").alias("_o")), key)
    own = ["paper_id", "equation_id", "sentence_id"]
    last = F.struct("_side", "_o")
    once = told.groupBy(*own).agg(F.min(last).alias("_first"), F.max_by(F.struct("section_id", "text", "position"), last).alias("_last"))
    place = F.row_number().over(Window.partitionBy("paper_id", "equation_id").orderBy("_first", "sentence_id")) - 1
    return once.withColumn("pos", place).select(*own, "_last.*", "pos")
