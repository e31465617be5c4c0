"""Directed relations between the equations of a paper, by rules or by an additive score (K5, K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.arrays import jaccard

# Cues, weights and thresholds that decide the results.
DERIVATION = r"(?i)\b(?:from|using|by|follows?\s+from|derived?\s+(?:from|using)|applying|substitut(?:ing|e)|plugging|combining)\b"
EQUIVALENCE = r"(?i)\b(?:equivalent\s+to|same\s+as|reduces?\s+to|simplif(?:ies|y)\s+to|equals?|identical\s+to|equal\s+to|recovers?)\b"
SPECIAL_CASE = r"(?i)\b(?:special\s+case|particular\s+case|setting\s+\S+\s+(?:=|to)|when\s+\S+\s+=|limit(?:ing\s+case)?|reducing\s+to)\b"
LABEL_REFERENCE = r"(?i)(?:eq(?:uation|n)?s?\.?\s*)?\(\s*([0-9]+(?:\.[0-9]+)?)\s*\)"
SYMBOL_OVERLAP, SIMILARITY, REFERENCE_DISTANCE = 0.4, 0.7, 200
SCORE_DERIVATION = r"(?i)\b(?:substitut\w*|insert\w*|using|use[ds]?|follows?\s+from|deriv(?:e|ed|es|ing|ation)|obtain\w*|yield\w*|rewrit\w*|integrat\w*|evaluat\w*)\b"
SCORE_EQUIVALENCE = r"(?i)\b(?:equivalent\s+to|same\s+as|identical\s+to|corresponds?\s+to)\b"
SCORE_SPECIAL_CASE = r"(?i)\b(?:special\s+case|reduces?\s+to|in\s+the\s+limit|by\s+setting|setting\s+\S+\s*(?:=|to)|for\s+zero)\b"
STRONG, POTENTIAL, CUE_REACH = 5.0, 2.0, 45
DESCRIPTIONS = {"derivation": "derived from", "equivalence": "equivalent", "special_case": "special case", "citation": "explicit citation"}


def labels_mentioned(text: Column) -> Column:
    """Numbers in brackets, with or without the word equation."""
    return F.regexp_extract_all(text, F.lit(LABEL_REFERENCE), F.lit(1))


def cue(text: Column) -> Column:
    """The kind of the first cue list that occurs in a text that mentions the label: derivation before equivalence before special case, else citation."""
    return F.when(text.rlike(DERIVATION), "derivation").when(text.rlike(EQUIVALENCE), "equivalence").when(text.rlike(SPECIAL_CASE), "special_case").otherwise("citation")


def section_proximity(a: Column, b: Column) -> Column:
    """1 in one section, 0.5 for sections of one kind (Q7), else 0 (M4)."""
    kind = lambda c: F.regexp_replace(c, ":?[^:]*$", "")
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(known & (a == b), 1.0).when(known & (kind(a) == kind(b)), 0.5).otherwise(0.0)


def pair_grid(equations: DataFrame) -> DataFrame:
    """All ordered pairs of different equations of a paper; the columns of either side are src_* and dst_*."""
    side = lambda prefix: equations.select("paper_id", *[F.col(c).alias(prefix + c) for c in equations.columns if c != "paper_id"])
    return side("src_").join(side("dst_"), "paper_id").filter("src_equation_id <> dst_equation_id")


def relations_by_rules(equations: DataFrame, references: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """(paper_id, src, dst, grade, description) for every ordered pair of a paper's equations.

    equations: paper_id, equation_id, label, section_id, document_order, texts (sentences around, in order), symbols
    (canonical names). references: paper_id, label, document_order. similarities: paper_id, src, dst, similarity. A
    cue in the first text around src that mentions dst decides (ids tell a paper's equations apart); then a reference to dst nearby; then shared
    symbols, similarity and section.
    """
    named = equations.withColumn("label", F.coalesce("label", "equation_id"))
    # What src says and what is cited near it goes with src, so that pairs, of which there are many, are not shuffled.
    said = F.filter("texts", lambda t: t.isNotNull())
    entries = F.flatten(F.transform(said, lambda t: F.transform(F.array_distinct(labels_mentioned(t)), lambda x: F.struct(x.alias("label"), cue(t).alias("cue")))))
    cited = references.groupBy("paper_id").agg(F.collect_set(F.struct("label", F.col("document_order").alias("at"))).alias("_refs"))
    near_by = F.filter("_refs", lambda r: F.abs(r["at"] - F.coalesce("src_document_order", F.lit(0))) < REFERENCE_DISTANCE)
    sources = named.select("paper_id", *[F.col(c).alias("src_" + c) for c in ("equation_id", "section_id", "symbols", "document_order")], entries.alias("_entries"))
    sources = sources.join(cited, "paper_id", "left").withColumn("_cited", F.transform(near_by, lambda r: r["label"])).drop("_refs", "src_document_order")
    other = named.select("paper_id", *[F.col(c).alias("dst_" + c) for c in ("equation_id", "section_id", "symbols", "label")])
    out = sources.join(other, "paper_id").filter("src_equation_id <> dst_equation_id")
    first = F.array_position(F.transform("_entries", lambda e: e["label"]), F.col("dst_label")).cast("int") - 1
    out = out.withColumn("_cue", F.get("_entries", first)["cue"]).withColumn("_cited", F.when(F.array_contains("_cited", F.col("dst_label")), F.lit("citation")))
    if similarities is None:
        out = out.withColumn("similarity", F.lit(0.0))
    else:
        out = out.join(similarities.withColumnsRenamed({"src": "src_equation_id", "dst": "dst_equation_id"}), ["paper_id", "src_equation_id", "dst_equation_id"], "left")
    kind = F.coalesce("_cue", "_cited")
    shared = jaccard(F.coalesce("src_symbols", F.array().cast("array<string>")), F.coalesce("dst_symbols", F.array().cast("array<string>")))
    near = (F.coalesce("similarity", F.lit(0.0)) >= SIMILARITY) | (section_proximity(F.col("src_section_id"), F.col("dst_section_id")) > 0)
    grade = F.when(kind.isNotNull(), "strong").when((shared >= SYMBOL_OVERLAP) | near, "potential").otherwise("none")
    told = F.element_at(F.create_map(*[F.lit(x) for p in DESCRIPTIONS.items() for x in p]), kind)
    description = F.when(kind.isNotNull(), told).when(shared >= SYMBOL_OVERLAP, "shares symbols").when(near, "same section context").otherwise("none")
    return out.select("paper_id", F.col("src_equation_id").alias("src"), F.col("dst_equation_id").alias("dst"), grade.alias("grade"), description.alias("description"))


def reference_pattern(equation_id: Column) -> Column:
    """A pattern, as a column, for mentions of an equation by number."""
    return F.concat(F.lit(r"(?i)\b(?:Eq(?:uation)?s?\.?|Equation)\s*(?:\(\s*)?\Q"), equation_id, F.lit(r"\E(?:\s*\))?(?![\d.])"))


def cue_near(text: Column, equation_id: Column, pattern: str) -> Column:
    """Whether a cue stands within CUE_REACH characters of the first mention of the equation."""
    mention = F.regexp_substr(text, reference_pattern(equation_id))
    start = F.instr(text, mention)
    reach = F.lit(CUE_REACH)
    before = F.substring(text, F.lit(1), start - 1)
    after = F.substring(text, start + F.length(mention), F.length(text))
    bare = F.lit(pattern.removeprefix("(?i)"))
    return F.coalesce(
        mention.isNotNull()
        & (F.regexp_like(before, F.concat(F.lit("(?is)"), bare, F.lit(".{0,"), reach.cast("string"), F.lit("}$"))) | F.regexp_like(after, F.concat(F.lit("(?is)^.{0,"), reach.cast("string"), F.lit("}?"), bare))),
        F.lit(False),
    )


def from_equation(text: Column, equation_id: Column) -> Column:
    """Whether the text says `from` right before its first mention of the equation."""
    mention = F.regexp_substr(text, reference_pattern(equation_id))
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?i)\bfrom\s+(?:the\s+)?\Q"), mention, F.lit(r"\E"))), F.lit(False))


def relations_by_score(equations: DataFrame, evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, src, dst, grade, description, score, shared_symbols, evidence_text, source_sentence_id) for every pair.

    equations: paper_id, equation_id, section_id, section_position, symbols, tokens (of the texts around, without
    stop words). evidence: paper_id, equation_id, sentence_id, sentence_ids, text, pos: sentences around an equation
    that introduce no other. resolved: paper_id, sentence_id, equation_id: references resolved to equations.
    """
    pairs = pair_grid(equations)
    grid = pairs.select("paper_id", F.col("src_equation_id").alias("src"), F.col("dst_equation_id").alias("dst"))
    named = evidence.withColumnRenamed("equation_id", "src").join(grid, ["paper_id", "src"])
    each = named.select("paper_id", "src", "dst", "pos", F.explode("sentence_ids").alias("sentence_id"))
    by_reference = each.join(resolved.withColumnRenamed("equation_id", "dst"), ["paper_id", "sentence_id", "dst"], "left_semi").select("paper_id", "src", "dst", "pos", F.lit(True).alias("_linked")).distinct()
    found = named.join(by_reference, ["paper_id", "src", "dst", "pos"], "left").filter(F.coalesce("_linked", F.lit(False)) | F.coalesce(F.regexp_like("text", reference_pattern(F.col("dst"))), F.lit(False)))
    text, dst = F.col("text"), F.col("dst")
    judged = found.withColumns({"_e": cue_near(text, dst, SCORE_EQUIVALENCE), "_s": cue_near(text, dst, SCORE_SPECIAL_CASE), "_d": cue_near(text, dst, SCORE_DERIVATION) | from_equation(text, dst)})
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rank = F.row_number().over(Window.partitionBy("paper_id", "src", "dst").orderBy(F.col("_e").desc(), F.col("_s").desc(), F.col("_d").desc(), spaces, "pos"))
    best = judged.withColumn("_r", rank).filter("_r = 1").select("paper_id", "src", "dst", F.col("text").alias("evidence_text"), F.col("sentence_id").alias("source_sentence_id"), "_e", "_s", "_d", F.lit(True).alias("_x"))
    out = pairs.withColumnsRenamed({"src_equation_id": "src", "dst_equation_id": "dst"}).join(best, ["paper_id", "src", "dst"], "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    shared = F.array_sort(F.array_intersect("src_symbols", "dst_symbols"))
    overlap, context = jaccard(F.col("src_symbols"), F.col("dst_symbols")), jaccard(F.col("src_tokens"), F.col("dst_tokens"))
    distance = F.abs(F.coalesce("src_section_position", F.lit(0)) - F.coalesce("dst_section_position", F.lit(0)))
    same = F.col("src_section_id").eqNullSafe(F.col("dst_section_id"))
    points = [F.when(is_("_x"), 5.0), F.when(is_("_d"), 4.0), F.when(is_("_e"), 3.0), F.when(is_("_s"), 3.0), F.bround(2.0 * overlap, 4), F.when(same, 1.0), F.bround(context, 4), F.when((distance > 0) & ~is_("_x"), -F.least(F.lit(2.0), distance.cast("double")))]
    score = F.bround(sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0)), 4)
    grade = F.when(is_("_x") | (score >= STRONG), "strong").when(score >= POTENTIAL, "potential").otherwise("none")
    description = F.when(is_("_e"), "equivalent").when(is_("_s"), "special case").when(is_("_d"), "derived from").when(is_("_x"), "explicit citation").when(F.size(shared) > 0, "shares symbols").otherwise("same section context")
    return out.select("paper_id", "src", "dst", grade.alias("grade"), F.when(grade == "none", "").otherwise(description).alias("description"), score.alias("score"), shared.alias("shared_symbols"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), "source_sentence_id")
