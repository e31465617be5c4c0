"""Sentences of retrieved chunks as evidence for a symbol, phrases in them, and what speaks for a definition."""

from __future__ import annotations

import re
from collections.abc import Iterable

from inkwell.functions.definitions import alias_pattern, is_valid, tidy

_I = re.IGNORECASE

# Patterns, weights and limits that decide the results. {alias} is the symbol's alternatives.
SENTENCE_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
HEADINGS = ("Section:", "Equation (")
PHRASE_PATTERNS = (
    ("cue_tail", r"{alias}\s+(?:denotes?|represents?|means?|refers?\s+to|stands?\s+for|is\s+defined\s+as|is|are)\s+(?P<phrase>[^.;]{1,220})"),
    ("let_be", r"\blet\s+{alias}\s+be\s+(?P<phrase>[^.;]{1,220})"),
    ("reverse_definition", r"(?:denote|define|represent|write|call)\s+(?P<phrase>[^.;]{1,220}?)\s+(?:as|by)\s+{alias}"),
    ("coordinated_right", r"\band\s+(?P<phrase>[^.;,]{1,100}?)\s+as\s+{alias}"),
    ("noun_before_symbol", r"(?P<phrase>(?:the|a|an)\s+[A-Za-z][A-Za-z0-9' -]{2,100}?)\s+{alias}(?!\s*(?:is|are|=))"),
    ("appositive", r"{alias}\s*,\s*(?P<phrase>(?:the|a|an)\s+[^,.;]{1,100})"),
)
WEIGHTS = {"alias_definition_pattern": 4.0, "definition_cue": 2.0, "near_target_equation": 2.0, "sentence_chunk": 1.0, "explicit_definition_construction": 1.0}
PARSED_WEIGHTS = {"spacy_dependency_pattern": 4.0, "copular_or_appositive_cue": 2.0}
EXPLICIT = {1: {"definition_before_symbol"}, 2: {"definition_before_symbol", "let_be"}}
LEAST_SCORE, FULL_SCORE, MOST_CANDIDATES = 6.0, 11.0, 48


def folded(text: str) -> str:
    return " ".join(text.split()).casefold()


def evidence(results: Iterable[dict]) -> list[tuple[str, dict]]:
    """(sentence, its result): equal sentences once, in the slot of the first, from a sentence chunk or the better score."""
    slots: dict[str, tuple[tuple, str, dict]] = {}
    for r in results:
        whole = (r["text"] or "").strip()
        for text in map(str.strip, [whole] if r["chunk_type"] == "sentence" else SENTENCE_BREAK.split(whole)):
            if text and not text.startswith(HEADINGS):
                rank, key = (r["chunk_type"] == "sentence", r["score"]), folded(text)
                if key not in slots or rank > slots[key][0]:
                    slots[key] = rank, text, r
    return [(text, r) for _, text, r in slots.values()]


def phrases_in(text: str, aliases: tuple[str, ...]) -> list[tuple[str, str]]:
    """(phrase, source) of every match of every pattern that gives a valid definition."""
    alias = alias_pattern(aliases)
    found = ((tidy(m["phrase"]), source) for source, p in (PHRASE_PATTERNS if alias else ()) for m in re.finditer(p.replace("{alias}", alias), text, _I))
    return [(phrase, source) for phrase, source in found if is_valid(phrase, aliases)]


def phrase_candidates(sentences: list[tuple[str, dict]], aliases: tuple[str, ...], noun_chunks=None) -> list[dict]:
    """phrase, source, sentence, result: each phrase of a sentence once.

    `noun_chunks` (sentence -> phrases) is what a language model would add; without one there are none.
    """
    out, seen = [], set()
    for text, result in sentences:
        more = [(tidy(p), "noun_chunk") for p in noun_chunks(text)] if noun_chunks else []
        for phrase, source in phrases_in(text, aliases) + more:
            key = phrase.casefold(), folded(text)
            if key not in seen and is_valid(phrase, aliases):
                seen.add(key)
                out.append({"phrase": phrase, "source": source, "sentence": text, "result": result})
    return out


def first_candidates(candidates: list[dict], most: int = MOST_CANDIDATES) -> list[dict]:
    """The first by rank, then score, then phrase."""
    return sorted(candidates, key=lambda c: (c["result"]["rank"], -c["result"]["score"], c["phrase"]))[:most]


def definition_features(result: dict, equation_id: str, best_score: float, strategy: str, generation: int) -> dict[str, float]:
    """What speaks for a definition found in a result; the sum is its score."""
    parsed = strategy == "spacy_dependency"
    hits = {"near_target_equation": equation_id in (result["nearby_equation_ids"] or []), "sentence_chunk": result["chunk_type"] == "sentence", "explicit_definition_construction": strategy in EXPLICIT[generation]}
    base = PARSED_WEIGHTS if parsed else {k: WEIGHTS[k] for k in ("alias_definition_pattern", "definition_cue")}
    out = base | {k: WEIGHTS[k] for k, hit in hits.items() if hit}
    return out | ({"retrieval_score": result["score"] / best_score} if best_score > 0 else {})
