"""Search tokens of scientific text, and the query strings built from equations and symbols."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and patterns that decide the results.
GREEK_NAMES = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), strict=True))
GREEK_NAMES |= dict(zip("ΓΔΘΛΞΠΣΥΦΨΩ", "gamma delta theta lambda xi pi sigma upsilon phi psi omega".split(), strict=True))
TOKEN = re.compile(r"\\[A-Za-z]+(?:_\{[^{}]+\}|_[A-Za-z0-9]+)?|[^\W\d_][\w]*(?:_[\w]+)*|\d+(?:\.\d+)?")
MEANING_CUES = ("defines", "describes", "represents", "gives", "called", "known as")


def tokenize(text: str) -> list[str]:
    """Commands, words and numbers in compatibility form; Greek letters by name; a_b also as a and b."""
    out = []
    for found in TOKEN.findall(text or ""):
        plain = unicodedata.normalize("NFKC", found)
        token = GREEK_NAMES.get(plain) or plain.removeprefix("\\").replace("_{", "_").replace("}", "").casefold()
        if token:
            out.append(token)
            out += [p for p in token.split("_") if p] if "_" in token else []
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_tokens(s: pd.Series) -> pd.Series:
    return s.map(tokenize)


def meaning_query(equation_id: Column, symbols: Column) -> Column:
    """Words that an explanation of an equation would hold."""
    return F.concat_ws(" ", F.lit("Eq"), equation_id, F.lit("Equation"), equation_id, *map(F.lit, MEANING_CUES), F.array_distinct(symbols))


def symbol_query(aliases: Column) -> Column:
    """What a definition of a symbol would say, and its names."""
    names = F.array_distinct(F.filter(aliases, lambda a: F.coalesce(a, F.lit("")) != ""))
    seed = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    return F.concat_ws(" ", F.lit("where"), seed, F.lit("is"), seed, F.lit("denotes"), names)


def symbol_context(original: Column, canonical: Column, equation: Column, sentence: Column) -> Column:
    """A symbol and its sentence as one input for a classifier."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in (("original LaTeX", original), ("canonical", canonical), ("equation", equation), ("context", sentence))])


def equation_representation(equation: Column, symbols: Column, candidate_symbols: Column, section_titles: Column) -> Column:
    """An equation as input for a reranker: its symbols, else those of its candidates, and the candidates' sections.

    section_titles has one entry for each candidate, some of them empty; parts that are missing are left out.
    """
    named = F.array_distinct(F.when(F.size(symbols) > 0, symbols).otherwise(candidate_symbols))
    titles = F.array_distinct(F.filter(section_titles, lambda t: F.coalesce(t, F.lit("")) != ""))
    return F.concat_ws(
        " | ", F.concat(F.lit("mathematical equation: "), equation), F.when(F.size(named) > 0, F.concat(F.lit("symbols: "), F.concat_ws(" ", named))),
        F.when(F.size(section_titles) > 0, F.concat(F.lit("section: "), F.concat_ws("; ", titles))),
    )


def candidate_context(phrase: Column, sentence: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("candidate phrase: "), phrase), F.concat(F.lit("evidence: "), sentence))
