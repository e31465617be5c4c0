"""Texts around one equation: the marked equation, references, entity spans."""

from __future__ import annotations

import re

MARKER = "[EQUATION]"
REFERENCE = re.compile(r"\bEq(?:uation)?(?P<many>s)?\.?\s*\(\s*(?P<body>[^)]*?)\s*\)", re.IGNORECASE)


def equation_window(paper_id: str, equation_id: str, equation: str, window: str) -> str:
    """The window with its equation in place of the marker, and references told apart: to this equation, to others."""
    n = window.count(MARKER)
    if n != 1:
        raise ValueError(f"one {MARKER} is needed in paper {paper_id!r}, equation {equation_id!r}; found {n}")
    told = REFERENCE.sub(lambda m: "<eqref>" if not m["many"] and m["body"] == equation_id else "<other_eqref>", window)
    return told.replace(MARKER, f"<starteqn> {equation} <endeqn>")


def merge_entities(text: str, entities: list[dict], name: str = "EQ_NAME") -> list[tuple[int, int, str]]:
    """(start, end, text) of spans from B- and I- tags by offsets; a space between members does not part them."""
    spans: list[list[int]] = []
    for e in sorted(entities, key=lambda e: e["start"]):
        if e["entity"] == f"I-{name}" and spans and not text[spans[-1][1] : e["start"]].strip():
            spans[-1][1] = e["end"]
        elif e["entity"] in (f"B-{name}", f"I-{name}"):
            spans.append([e["start"], e["end"]])
    trimmed = ((a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in spans)
    return [(a, b, text[a:b]) for a, b in trimmed if a < b]


def answer_metrics(gold: list[dict], predicted: dict[tuple, dict]) -> dict[str, float]:
    """Exact match over all, precision and recall of answers, accuracy where there is none."""
    rows = [(g, predicted.get((g["paper_id"], g["equation_id"]), {}).get("meaning", "")) for g in gold]
    share = lambda part: sum(part) / len(part) if part else 0.0
    return {
        "exact_match": share([p == g["meaning"] for g, p in rows]),
        "answer_precision": share([p == g["meaning"] for g, p in rows if p]),
        "answer_recall": share([p == g["meaning"] for g, p in rows if g["has_answer"]]),
        "no_answer_accuracy": share([not p for g, p in rows if not g["has_answer"]]),
    }
