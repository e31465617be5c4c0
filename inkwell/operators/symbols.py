"""Symbols of equations, their definitions, and phrase cleanup, as DataFrame operators over the Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import definitions, latex, phrases

_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCANNED = T.ArrayType(_struct(canonical=_S, latex_forms=_L, aliases=_L))
MARKED = T.ArrayType(_struct(canonical=_S, latex_forms=_L, unicode=_S, base=_S, modifiers=_L))
PARSED = _struct(original_latex=_S, base=_S, subscript=_S, superscript=_S, decorators=_L)
DEFINED = _struct(definition=_S, strategy=_S, alias=_S)
CANDIDATE = _struct(raw=_S, phrase=_S, strategy=_S, score=T.IntegerType(), accepted=T.BooleanType(), reasons=_L)
CLEANED = _struct(
    meaning=_S, applied=T.BooleanType(), flagged=T.BooleanType(), strategy=_S, original_meaning=_S, removed_prefix=_S,
    removed_suffix=_S, candidates=T.ArrayType(CANDIDATE), extractive=T.BooleanType(),
)


@F.pandas_udf(SCANNED)
def scan_symbols(s: pd.Series) -> pd.Series:
    """Symbols of LaTeX with forms and aliases (L1)."""
    return s.map(latex.scan_symbols)


@F.pandas_udf(MARKED)
def markup_symbols(mathml: pd.Series, text: pd.Series) -> pd.Series:
    """Symbols of MathML, else of LaTeX, with modifiers."""
    return pd.Series([latex.markup_symbols(None if m is None else list(m), t) for m, t in zip(mathml, text, strict=True)])


@F.pandas_udf(PARSED)
def parse_symbol(forms: pd.Series, canonical: pd.Series) -> pd.DataFrame:
    """Base, scripts and decorators of a symbol (L3)."""
    parsed = [latex.parse_symbol(list(f) if f is not None else [], c or "") for f, c in zip(forms, canonical, strict=True)]
    return pd.DataFrame(parsed, columns=["original_latex", "base", "subscript", "superscript", "decorators"])


@F.pandas_udf(DEFINED)
def define_by_cue(text: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    """Definition of a symbol in a sentence by ordered cues (X11)."""
    return pd.DataFrame([definitions.define_by_cue(t or "", tuple(a) if a is not None else ()) for t, a in zip(text, aliases, strict=True)], columns=["definition", "strategy", "alias"])


@F.pandas_udf(_L)
def phrase_reasons(phrase: pd.Series) -> pd.Series:
    """Why a phrase cannot stand for a concept."""
    return phrase.map(lambda p: phrases.reject_reasons(p or ""))


@F.pandas_udf(CLEANED)
def clean_phrase(meaning: pd.Series, strategy: pd.Series, source_text: pd.Series) -> pd.DataFrame:
    """The concept phrase of a meaning, with its audit."""
    return pd.DataFrame([phrases.postprocess(m, s, t) for m, s, t in zip(meaning, strategy, source_text, strict=True)])


def equation_symbols(equations: DataFrame) -> DataFrame:
    """One row for each symbol of an equation."""
    found = equations.select("paper_id", "equation_id", F.explode(markup_symbols("mathml", "latex")).alias("s"))
    return found.select("paper_id", "equation_id", "s.*")


def chunk_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add to chunks the distinct symbols of the equations near them, in order."""
    near = chunks.select("paper_id", "chunk_id", F.posexplode("nearby_equation_ids").alias("_k", "equation_id"))
    listed = symbols.select("paper_id", "equation_id", "canonical", F.row_number().over(Window.partitionBy("paper_id", "equation_id").orderBy("ordinal")).alias("_o"))
    got = near.join(listed, ["paper_id", "equation_id"]).groupBy("paper_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_o", "canonical"))).alias("_s"))
    named = got.select("paper_id", "chunk_id", F.array_distinct(F.transform("_s", lambda x: x["canonical"])).alias("symbols"))
    return chunks.drop("symbols").join(named, ["paper_id", "chunk_id"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


Ranker = Callable[[list[str], list[str]], list[list[float]]]


def overlap_ranker(queries: list[str], sentences: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: shared words over the sentence's words, so that results need no network."""
    sets = [set(s.lower().split()) for s in sentences]
    return [[len(set(q.lower().split()) & s) / (len(s) or 1) for s in sets] for q in queries]


def symbol_definitions(symbols: DataFrame, equations: DataFrame, sentences: DataFrame, ranker: Ranker = overlap_ranker, top_k: int = 30) -> DataFrame:
    """(paper_id, equation_id, canonical, definition, pattern, confidence, sentence_id, retrieval_rank) (K4).

    Each paper's sentences are ranked for each symbol by `ranker` (queries, sentences -> scores), ties by place; the
    first of the top_k with a definition gives it. Work is by paper.
    """
    schema = "paper_id string, equation_id string, canonical string, definition string, pattern string, confidence double, sentence_id string, retrieval_rank int"
    own = symbols.join(equations.select("paper_id", "equation_id", "latex"), ["paper_id", "equation_id"])
    grouped = own.groupBy("paper_id").agg(F.collect_list(F.struct("equation_id", "canonical", "unicode", "base", "latex_forms", "latex")).alias("symbols"))
    texts = sentences.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("document_order", "order", "sentence_id", "text"))).alias("sentences"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                body = [(s["sentence_id"], s["text"]) for s in row.sentences]
                named: dict[str, list[tuple]] = {}
                for s in row.symbols:
                    named.setdefault(s["equation_id"], []).append((s, tuple(a for a in dict.fromkeys([s["canonical"], s["unicode"], s["base"], *s["latex_forms"]]) if a)))
                for equation_id, found in named.items():
                    queries = [" ".join([f"where {a[0]} is", f"{a[0]} denotes", *a]) for _, a in found]
                    for (s, a), scores in zip(found, ranker(queries, [t for _, t in body]), strict=True):
                        ranked = sorted(range(len(body)), key=lambda k: (-scores[k], k))[:top_k]  # noqa: B023
                        hit = definitions.find_definition([body[k][1] for k in ranked], a, s["latex"] or "", [x for _, x in found])
                        if hit:
                            out.append((row.paper_id, equation_id, s["canonical"], hit[0], hit[1], hit[2], body[ranked[hit[3]]][0], hit[3] + 1))
            yield pd.DataFrame(out, columns=["paper_id", "equation_id", "canonical", "definition", "pattern", "confidence", "sentence_id", "retrieval_rank"])

    return grouped.join(texts, "paper_id").mapInPandas(find, schema)
