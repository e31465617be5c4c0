"""Candidate sentences for an equation's meaning: where they stand, what span they give, what speaks for them."""

from __future__ import annotations

import re

_I = re.IGNORECASE

# Patterns and weights that decide the results. {eq} is the equation's number.
DISCOURSE_PREFIX = re.compile(r"^(?:therefore|thus|hence|consequently|in this case|so),?\s+", _I)
#: (strategy, pattern with a group `span`, whether it holds only right before the equation, whether it must match from the start)
SPAN_PATTERNS = (
    ("anchor_subject", r"^(?P<span>(?:the|a|an)\s+.{3,220}?)\s+(?:can\s+be|may\s+be|is|are|was|were)\s+(?:readily\s+)?(?:written|given|expressed|defined|represented|described|evaluated|obtained)(?:\s+\w+){0,2}\s*(?:as|by|using|from)?\s*:?[.!]?$", True),
    ("anchor_subject", r"^(?P<span>(?:the|a|an)\s+.{3,180}?)\s+(?:is|are)\s*:?[.!]?$", True),
    ("anchor_object", r"^.*?\b(?:we|one)\s+(?:write\s+down|write|express|represent|formulate)\s+(?P<span>(?:the|a|an)\s+.{3,180}?)\s+(?:in\s+the\s+form|as|by)\s*:?[.!]?$", True),
    ("explicit_description", r"\b(?:Eq(?:uation)?\.?\s*\(?\s*{eq}\s*\)?|Equation\s*\(?\s*{eq}\s*\)?)\s+(?:defines|describes|represents|gives|is|corresponds\s+to)\s+(?P<span>.{3,180}?)[.!]?$", False),
    ("derived_object", r"\b(?:derive|obtain|give|gives|yield|yields)\s+(?P<span>(?:the|a|an)\s+.{3,160}?)[.!]?$", False),
)
DEFINITION_CUE = re.compile(r"\b(?:defines?|describes?|represents?|gives?|given\s+by|written\s+as|expressed\s+as|known\s+as|called|corresponds\s+to|derive[ds]?|obtain(?:ed|s)?|yield(?:s|ed)?)\b", _I)
NAMED_CONCEPT = re.compile(r"\b(?:Hamiltonian|wave\s+function|characteristic\s+function|covariance\s+matrix|density\s+matrix|dispersion\s+relation|equation\s+of\s+motion|motion\s+equation|probability\s+distribution|plane\s+wave|state\s+vector|transformation|displacement|potential|energy|entropy|current|solution)\b", _I)
PROCEDURAL_FRAGMENT = re.compile(r"\b(?:substitut|insert)\w*\b.*\b(?:obtain|give|yield)\s*:?[.!]?$", _I)
INCOMPLETE_ENDING = re.compile(r"\b(?:as|by|from|form|is|are|obtain|obtained|give|given|yield|yields)\s*:?[.!]?$", _I)
MENTION = r"\b(?:Eq(?:uation)?s?\.?|Equation)\s*\(?\s*{eq}(?:\s*[,)-]|\s*$)"
EQUATION_LINE = r"^Equation\s*\(\s*{eq}\s*\)\s*:"
SENTENCE_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
ADJACENT = ("before_equation", "after_equation")
WEIGHTS = {"explicit_equation_reference": 5.0, "definition_cue": 3.0, "named_concept": 3.0, "equation_adjacent": 2.0, "exact_equation_neighborhood": 2.0, "length_penalty": -1.0}
ACCEPTED_SCORE, RERANK_WEIGHT = 6.0, 2.0


def of(pattern: str, equation_id: str) -> re.Pattern:
    return re.compile(pattern.replace("{eq}", re.escape(equation_id)), _I)


def extract_span(text: str, equation_id: str, position: str) -> tuple[str, str]:
    """(span, strategy) by the first pattern that fits, else the sentence itself."""
    plain = DISCOURSE_PREFIX.sub("", text.strip())
    for strategy, pattern, only_before in SPAN_PATTERNS:
        if not only_before or position == "before_equation":
            if m := of(pattern, equation_id).search(plain):
                return m["span"].strip(), strategy
    return plain, "source_sentence"


def candidates(chunk_text: str, equation_id: str) -> list[tuple[str, str]]:
    """(sentence, position) of a chunk's lines but its headings; the neighbours of the equation's line are adjacent."""
    lines = [x for x in map(str.strip, chunk_text.splitlines()) if x]
    target = of(EQUATION_LINE, equation_id)
    at = next((k for k, x in enumerate(lines) if target.match(x)), None)
    out = []
    for k, line in enumerate(lines):
        if line.startswith(("Section:", "Equation (")):
            continue
        parts = [p for p in map(str.strip, SENTENCE_BREAK.split(line)) if p]
        for i, p in enumerate(parts):
            before = at is not None and k == at - 1 and i == len(parts) - 1
            after = at is not None and k == at + 1 and i == 0
            out.append((p, "before_equation" if before else "after_equation" if after else "retrieved"))
    return out


def features(text: str, position: str, chunk_id: str, equation_id: str, retrieval: float, reranked: float | None = None) -> dict[str, float]:
    """What speaks for a candidate; the sum is its score (A17). `retrieval` is its share of the best retrieval score."""
    hits = {
        "explicit_equation_reference": of(MENTION, equation_id).search(text),
        "definition_cue": DEFINITION_CUE.search(text),
        "named_concept": NAMED_CONCEPT.search(text),
        "equation_adjacent": position in ADJACENT,
        "exact_equation_neighborhood": chunk_id.endswith(f":equation_neighborhood:{equation_id}"),
        "length_penalty": not 4 <= len(text.split()) <= 60,
    }
    out = {name: WEIGHTS[name] for name, hit in hits.items() if hit}
    if retrieval:
        out["retrieval_score"] = retrieval
    if reranked is not None:
        out["mathbert_similarity"] = reranked * RERANK_WEIGHT
    return out


def filter_reasons(text: str, strategy: str, position: str) -> list[str]:
    """Reasons noted against a candidate, which stays eligible (F8)."""
    fragment = strategy == "source_sentence" and (PROCEDURAL_FRAGMENT.search(text) or INCOMPLETE_ENDING.search(text))
    supported = DEFINITION_CUE.search(text) or NAMED_CONCEPT.search(text) or position == "before_equation"
    return [name for name, hit in (("procedural_or_incomplete", fragment), ("missing_cue_or_before_equation_anchor", not supported)) if hit]
