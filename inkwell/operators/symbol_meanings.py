"""Definitions of symbols from retrieved chunks, in two generations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import definitions, evidence

# What retrieval adds to a symbol's aliases, which labels define a symbol, and the gate's defaults.
QUERY_CUES = ("denotes", "represents", "is defined as", "is the", "are the", "where")
COMPLETE, BASE = "DEFINES_COMPLETE_SYMBOL", "DEFINES_BASE"
GATE = {"threshold": 0.9980401396751404, "margin": 0.10, "acceptance_enabled": True}

#: (symbol as dict, candidates as dicts) -> for each candidate a map from label to probability
Classifier = Callable[[dict, list[dict]], list[dict[str, float]]]
#: (sentence, aliases) -> (definition, alias), both empty if there is none: what a dependency parser would find
Dependency = Callable[[str, tuple[str, ...]], tuple[str, str]]

RESULT = "paper_id string, equation_id string, canonical string, definition string, confidence double, strategy string, source_text string, source_chunk_id string, candidate_score double, candidate_count int, rejection_reason string, features string"


def symbol_query(aliases: list[str], cues: tuple[str, ...] = QUERY_CUES) -> str:
    """The query for a symbol's evidence: its aliases, each once, and the cues."""
    return " ".join([*dict.fromkeys(a.strip() for a in aliases if a.strip()), *cues])


def accept(candidates: list[dict], chances: list[dict[str, float]], modified: bool, gate: dict) -> tuple[dict | None, str | None]:
    """The candidate whose label defines the symbol, clear of the gate, or why there is none (M5, M7)."""
    if not gate.get("acceptance_enabled", True):
        return None, "reviewed_precision_gate_not_satisfied"
    kept, reasons = [], []
    for c, p in zip(candidates, chances, strict=True):
        label = max(p, key=p.get)
        ranked = sorted(p.values(), reverse=True)
        if ranked[0] < gate["threshold"]:
            reasons.append("below_relation_threshold")
        elif ranked[0] - (ranked[1] if len(ranked) > 1 else 0.0) < gate["margin"]:
            reasons.append("ambiguous_relation_margin")
        elif label == COMPLETE or (label == BASE and not modified):
            kept.append((ranked[0], -c["result"]["rank"], c["phrase"], c))
        else:
            reasons.append("component_or_non_definition_relation")
    if not kept:
        return None, reasons[0] if reasons else "no_definition_relation"
    best = max(kept, key=lambda x: x[:3])
    return best[3] | {"chance": best[0]}, None


def meaning_of(symbol: dict, results: list[dict], generation: int = 2, classifier: Classifier | None = None, dependency: Dependency | None = None, gate: dict | None = None) -> dict:
    """The definition of one symbol from its ranked results.

    A cue pattern in a sentence that mentions the symbol decides, if the features reach LEAST_SCORE. Then, in the first
    generation, nothing else (a dependency parser, if given, helps out sentence by sentence); in the second a
    classifier, if given, judges the phrases around the symbol.
    """
    aliases = tuple(dict.fromkeys(symbol["aliases"] or ()))
    found = evidence.evidence(results)
    told = [(t, r) for t, r in found if definitions.mentions(t, aliases)]
    best = max((r["score"] for r in results), default=0.0) if generation == 1 else max((r["score"] for _, r in found), default=0.0)
    out = {"definition": "", "confidence": 0.0, "strategy": "no_reliable_definition", "source_text": "", "source_chunk_id": None, "candidate_score": None, "candidate_count": len(found), "rejection_reason": None, "features": "{}"}
    scored = []
    for text, r in told:
        definition, strategy, _ = definitions.define_by_cue(text, aliases, definitions.CUE_PATTERNS if generation == 1 else definitions.CUE_PATTERNS_2)
        if not definition and generation == 1 and dependency:
            definition, _ = dependency(text, aliases)
            strategy = "spacy_dependency"
        if definition:
            parts = evidence.definition_features(r, symbol["equation_id"], best, strategy, generation)
            scored.append((sum(parts.values()), -r["rank"], definition, strategy, text, r, parts))
    winner = max(scored, key=lambda x: x[:3], default=None)
    if winner and winner[0] >= evidence.LEAST_SCORE:
        score, _, definition, strategy, text, r, parts = winner
        return out | {"definition": definition, "confidence": round(min(1.0, score / evidence.FULL_SCORE), 4), "strategy": strategy, "source_text": text, "source_chunk_id": r["chunk_id"], "candidate_score": round(score, 4), "features": json.dumps(parts)}
    if generation == 1 or classifier is None:
        return out | {"rejection_reason": "no_supported_definition_pattern" if told else "no_retrieved_alias"}
    candidates = evidence.first_candidates(evidence.phrase_candidates(found, aliases))
    if not candidates:
        return out | {"rejection_reason": "no_extractive_phrase_candidates"}
    chances = classifier(symbol, candidates)
    if len(chances) != len(candidates):
        raise ValueError("a classifier must return one map for each candidate")
    chosen, reason = accept(candidates, chances, bool(symbol.get("has_modifiers")), GATE | (gate or {}))
    if chosen is None:
        return out | {"rejection_reason": reason}
    return out | {"definition": chosen["phrase"], "confidence": round(chosen["chance"], 4), "strategy": "mathbert_cross_encoder", "source_text": chosen["sentence"], "source_chunk_id": chosen["result"]["chunk_id"], "candidate_score": round(chosen["chance"], 4)}


def symbol_meanings(symbols: DataFrame, results: DataFrame, generation: int = 2, classifier: Classifier | None = None, dependency: Dependency | None = None, gate: dict | None = None) -> DataFrame:
    """One row for each symbol: its definition, empty if none is reliable, where it is from, and why not (K4).

    symbols: paper_id, equation_id, canonical, aliases, has_modifiers. results: the same key, rank, score, chunk_id,
    chunk_type, text, nearby_equation_ids; a symbol's results are the top k of a search, so one row holds them.
    """
    if generation not in (1, 2):
        raise ValueError(f"unknown generation: {generation}")
    key = ["paper_id", "equation_id", "canonical"]
    listed = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id", "chunk_type", "text", "nearby_equation_ids"))).alias("results"))
    joined = symbols.select(*key, "aliases", "has_modifiers").join(listed, key, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in RESULT.split(",")]
        for frame in frames:
            rows = []
            for s in frame.to_dict("records"):
                plain = lambda v: list(v) if v is not None and not isinstance(v, float) else []
                found = [dict(r, nearby_equation_ids=plain(r["nearby_equation_ids"])) for r in plain(s["results"])]
                own = {k: s[k] for k in key} | {"aliases": plain(s["aliases"]), "has_modifiers": s["has_modifiers"]}
                rows.append({k: s[k] for k in key} | meaning_of(own, found, generation, classifier, dependency, gate))
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, RESULT)
