"""Text predicates that reject candidate sentences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide the results.
PROCEDURAL = r"^\s*(?:We|To|Note\s+that|It\s+follows)\b"
SYMBOL_DEFINITION = r"(?i)\b(?:where\s+\\?[A-Za-z][A-Za-z0-9_{}^\\]*\s+(?:is|are)|\\?[A-Za-z][A-Za-z0-9_{}^\\]*\s+denotes?|let\s+\\?[A-Za-z])\b"
LATEXISH = r"(?:\\[A-Za-z]+|[_^{}=+\-*/]|[A-Za-z]_[A-Za-z0-9])"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def reasons(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda r: r.isNotNull())


def hard_filter_reasons(text: Column) -> Column:
    """procedural, math_heavy, symbol_definition, incomplete."""
    n = count(text, "[A-Za-z0-9]+")
    bare = F.trim(text)
    unclosed = count(bare, r"\(") > count(bare, r"\)")
    return reasons(
        ("procedural", text.rlike(PROCEDURAL)),
        ("math_heavy", count(text, LATEXISH) / F.greatest(n, F.lit(1)) > 0.4),
        ("symbol_definition", text.rlike(SYMBOL_DEFINITION)),
        ("incomplete", (n < 5) | bare.endswith(",") | bare.endswith(":") | unclosed),
    )


def penalty(found: Column, each: float = 0.08, most: float = 0.25) -> Column:
    """What the reasons take from a score (Q3)."""
    return F.least(F.lit(most), each * F.size(found))
