"""Training rows for a relation classifier from accepted and rejected definitions, and a baseline classifier."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_I = re.IGNORECASE

# Labels, patterns and limits that decide the results.
COMPLETE, BASE, SUBSCRIPT, SUPERSCRIPT, RELATED, NONE = "DEFINES_COMPLETE_SYMBOL", "DEFINES_BASE", "QUALIFIES_SUBSCRIPT", "QUALIFIES_SUPERSCRIPT", "RELATED_NOT_DEFINITION", "NO_RELATION"
LABELS = (COMPLETE, BASE, SUBSCRIPT, SUPERSCRIPT, RELATED, NONE)
PER_SYMBOL, LONGEST_PHRASE = 6, 500
DECORATED = r"\\(?:bar|vec|hat|tilde|dot|ddot|overline)"
PHRASES = (
    r"\b(?:denotes?|represents?|means?|refers?\s+to|stands?\s+for|is\s+defined\s+as|are\s+defined\s+as|let\s+\S+\s+be)\s+(?P<phrase>[^.;]{1,180})",
    r"\b(?:is|are)\s+(?:the|a|an)\s+(?P<phrase>[^.;]{1,180})",
    r"\b(?:denote|define|represent|write)\s+(?P<phrase>[^.;]{1,180}?)\s+(?:as|by)\s+",
)
NEXT_DEFINITION = re.compile(r",?\s+and\s+(?:\\?[A-Za-z][^,]{0,40})\s+(?:is|are|denotes?|represents?)\b", _I)
INDEXED = re.compile(r"\b(?:subscript|indexed by|index)\b[^.;]{0,80}", _I)


def has_modifiers(canonical: str, forms: list[str]) -> bool:
    text = " ".join(forms)
    return "_" in canonical or bool(re.search(r"[_^]", text) or re.search(DECORATED + r"\b", text))


def base_aliases(canonical: str, forms: list[str]) -> list[str]:
    found = (re.match(rf"(?:{DECORATED}\s*\{{)?(\\[A-Za-z]+|[A-Za-z])", f.strip()) for f in forms)
    return [a for a in dict.fromkeys([*(m[1] for m in found if m), canonical.split("_")[0]]) if a]


def phrase_of(text: str) -> str:
    """What a sentence says a symbol is, or the sentence."""
    m = next((m for p in PHRASES if (m := re.search(p, text, _I))), None)
    if m is None:
        return " ".join(text.split())[:LONGEST_PHRASE]
    return NEXT_DEFINITION.split(" ".join(m["phrase"].split()).strip(" ,;:.()"), maxsplit=1)[0][:LONGEST_PHRASE]


def modifier_of(canonical: str, forms: list[str], text: str) -> tuple[str, str] | None:
    """A word for the symbol's superscript or subscript, with its label."""
    joined = " ".join(forms)
    for letter, word in (("L", "left"), ("R", "right")):
        if (f"_sup_{letter.lower()}" in canonical.casefold() or re.search(rf"\^\{{?{letter}\}}?", joined)) and re.search(rf"\b{word}\b", text, _I):
            return word, SUPERSCRIPT
    m = INDEXED.search(text)
    return (m[0], SUBSCRIPT) if m else None


def weak_label(canonical: str, forms: list[str], aliases: list[str], text: str, mentioned: bool) -> tuple[str, str]:
    """(phrase, label) for a rejected sentence."""
    exact = any(f.strip() and f.strip() in text for f in forms)
    modifier = modifier_of(canonical, forms, text)
    if modifier and exact:
        return modifier
    based = (re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9_^])\s+(?:denotes?|represents?|is\s+(?:the|a|an)\b)", text, _I) for a in base_aliases(canonical, forms))
    if has_modifiers(canonical, forms) and not exact and any(based):
        return phrase_of(text), BASE
    long = lambda a: a.startswith("\\") or len(a) > 1
    present = any(a in text if long(a) else re.search(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", text) for a in map(str.strip, aliases) if a)
    return phrase_of(text), RELATED if mentioned and present else NONE


@F.pandas_udf(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("label", T.StringType())]))
def _weak(canonical: pd.Series, forms: pd.Series, aliases: pd.Series, text: pd.Series, mentioned: pd.Series) -> pd.DataFrame:
    listed = lambda v: list(v) if v is not None else []
    rows = zip(canonical, forms, aliases, text, mentioned, strict=True)
    return pd.DataFrame([weak_label(c or "", listed(f), listed(a), t or "", bool(m)) for c, f, a, t, m in rows], columns=["phrase", "label"])


def training_rows(symbols: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted definitions and weakly labelled rejected sentences, one of equal rows.

    symbols: paper_id, equation_id, canonical, latex_forms, aliases, latex. accepted: key, definition, source_text.
    rejected: key, rank, text, alias_mentioned; the first PER_SYMBOL of a symbol count. Rows without a symbol go.
    """
    key = ["paper_id", "equation_id", "canonical"]
    first = rejected.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).filter(F.col("_r") <= PER_SYMBOL)
    bad = first.join(symbols, key).withColumn("w", _weak("canonical", "latex_forms", "aliases", "text", "alias_mentioned"))
    good = accepted.join(symbols, key)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    shape = lambda df, phrase, sentence, label, source: df.select(*key, F.coalesce(F.get("latex_forms", F.lit(0)), F.col("canonical")).alias("original_latex"), F.col("latex").alias("equation"), squeeze(phrase).alias("phrase"), squeeze(sentence).alias("sentence"), label.alias("label"), F.lit(source).alias("weak_label_source"), (F.contains("canonical", F.lit("_")) | F.concat_ws(" ", "latex_forms").rlike(rf"[_^]|{DECORATED}\b")).alias("has_modifiers"))
    both = shape(good, F.col("definition"), F.col("source_text"), F.lit(COMPLETE), "accepted_regex").unionByName(shape(bad, F.col("w.phrase"), F.col("text"), F.col("w.label"), "rejected_bm25"))
    kept = both.filter("phrase <> '' and sentence <> ''")
    rank = F.row_number().over(Window.partitionBy(*key, F.lower("phrase"), F.lower("sentence"), "label").orderBy("weak_label_source", "phrase", "sentence"))
    return kept.withColumn("_r", rank).filter("_r = 1").drop("_r")


def hard_negatives(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """A definition's phrase paired with the other symbols of its equation."""
    other = symbols.select("paper_id", "equation_id", F.col("canonical").alias("_other"))
    return rows.join(other, ["paper_id", "equation_id"]).filter(F.col("_other") != F.col("canonical")).select("paper_id", "equation_id", F.col("_other").alias("canonical"), "phrase", "sentence", F.lit(NONE).alias("label"), F.lit("wrong_symbol_same_context").alias("weak_label_source"), F.col("canonical").alias("hard_negative_for"))


def review_sample(rows: DataFrame, per_stratum: int = 25) -> DataFrame:
    """Rows for review: the first of each stratum by digest, with all strata of a row together.

    rows: key, phrase, sentence, relation, has_modifiers. Strata are the relation, `modifier` and `coordinated`.
    """
    key = ["paper_id", "equation_id", "canonical", "phrase", "sentence"]
    strata = F.filter(F.array(F.col("relation"), F.when(F.col("has_modifiers"), "modifier"), F.when(F.contains(F.lower("sentence"), F.lit(" and ")), "coordinated")), lambda s: s.isNotNull())
    each = rows.select("*", F.explode(strata).alias("stratum"))
    digest = F.sha2(F.concat_ws(":", "paper_id", "equation_id", "canonical", "phrase", "stratum"), 256)
    taken = each.withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(digest, "sentence"))).filter(F.col("_r") <= per_stratum)
    return taken.groupBy(*key).agg(F.array_sort(F.collect_set("stratum")).alias("review_strata"), F.min("relation").alias("predicted_relation"))


def baseline_classifier(rows: DataFrame, features: int = 4096, iterations: int = 30):
    """A logistic regression over hashed words of phrase and sentence, weighted by inverse label counts; no neural model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer, Tokenizer

    from inkwell.operators.evaluate import class_weights

    weighed = rows.join(class_weights(rows), "label").withColumn("words_in", F.concat_ws(" ", "phrase", "sentence"))
    steps = [StringIndexer(inputCol="label", outputCol="y"), Tokenizer(inputCol="words_in", outputCol="_w"), HashingTF(numFeatures=features, inputCol="_w", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=iterations)]
    return Pipeline(stages=steps).fit(weighed)


def calibrated(reviewed: DataFrame, precision: float = 0.9, least: int = 10) -> Column | None:
    """The threshold that reviewed rows (score, gold_relation, predicted_relation) justify; None leaves the model unused."""
    from inkwell.operators.evaluate import threshold_sweep

    rows = reviewed.filter(F.col("gold_relation").isNotNull()).withColumn("_good", F.col("gold_relation") == F.col("predicted_relation"))
    found = threshold_sweep(rows, "score", "_good", precision, least).first()
    return None if found is None else F.lit(found["threshold"])
