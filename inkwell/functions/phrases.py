"""Short concept phrases from sentences: candidates by template and by window, checked, scored, the best one kept.

Everything kept is a verbatim part of the sentence. Runs in Python functions over Arrow batches, since offsets and
nested alternatives are beyond SQL's regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Patterns, word lists and scores that decide the results.
MAX_WORDS = 12
_I = re.IGNORECASE
WORD = re.compile(r"[A-Za-z]+(?:[-'][A-Za-z]+)?")
LEADING_DROP = re.compile(r"^(?:(?:a|an|the|our|their|this|these|those|its)\s+)+", _I)
DISCOURSE_PREFIX = re.compile(r"^(?:therefore|thus|hence|consequently|furthermore|finally|next|now),?\s+", _I)
LEADING_NOISE = re.compile(r"^(?:(?:for\s+example|for\s+instance|for)\s+)+", _I)
CLAUSE_BOUNDARY = re.compile(r"(?:,\s+(?:we|one|it|they)\b|\s+\b(?:where|which|whose|that|using|given\s+by|known\s+as|with\s+\S+\s+being)\b)", _I)
TRAILING_REFERENCE = re.compile(r"(?:\s*\[\s*[^]]*\s*\]|\s*\(?\s*(?:Eq(?:uation)?|Fig(?:ure)?|Sec(?:tion)?|Appendix)\.?\s*\(?\s*\d+[^.;:]*\)?\s*)+$", _I)
EQUATION_REFERENCE = re.compile(r"(?:\bEq(?:uation)?s?\.?\s*\(?\s*\d+|\\eqref\b)", _I)
REFERENCE_BOUNDARY = re.compile(r"\s+(?:in|from|using|of)\s+(?:Eq(?:uation)?s?\.?\s*\(?\s*\d+|\\eqref\b)", _I)
LETTER = re.compile(r"[A-Za-z]")
LATEX_COMMAND = re.compile(r"\\[A-Za-z]+")
INCOMPLETE_EDGE = re.compile(r"^(?:we|one|it|such|to|of|as|and|by|in|from|then|account|taking|resulting|operatorname|mathrm|text)\b|\b(?:a|an|the|and|as|by|eq|equation|for|from|in|of|or|to|via|with)\s*$", _I)
SYMBOL_DEFINITION_START = re.compile(r"^\s*(?:where\b|with\s+(?:\\|[A-Za-z](?:\s|[_({]))|(?:Here,?|In\s+Eq(?:uation)?\.?[^,]*,)\s+(?:\\|[A-Za-z](?:[_({]|\s+(?:is|are|denotes?|represents?))))", _I)
SEGMENT_BREAK = re.compile(r"[,;:]|\b(?:where|which|whose|that|because|since|if|then)\b", _I)
#: what ends the phrase of a template that begins with any word, and the greatest length of the phrase after its first letter
INTRODUCED = r"\s+(?:(?:can|may|could|shall|will)\s+be|(?:is|are|was|were))\s+(?:readily\s+)?(?:written|given|expressed|defined|represented|described|evaluated|obtained|constructed|approximated|interpreted|characterized|formulated|calculated)\b"
FORMED = r"\s+(?:takes?|has)\s+the\s+form\b"
ENDS = {"subject_before_introduction": (re.compile(f"(?={INTRODUCED})", _I), 180), "subject_takes_form": (re.compile(f"(?={FORMED})", _I), 160)}
ARTICLE = 6  # characters of the longest article and its space
#: (strategy, score, pattern with a group `phrase`)
TEMPLATES = (
    ("subject_before_introduction", 90, re.compile(r"(?P<phrase>(?:(?:the|a|an|our|this|these|their)\s+)?[A-Za-z][^,;:\n]{1,180}?)" + INTRODUCED, _I)),
    ("subject_takes_form", 88, re.compile(r"(?P<phrase>(?:(?:the|a|an|our|this|these|their)\s+)?[A-Za-z][^,;:\n]{1,160}?)" + FORMED, _I)),
    ("reported_claim_subject", 86, re.compile(r"\b(?:one|we)\s+(?:can\s+|may\s+)?(?:observes?|see|find|note)\s+that\s+(?P<phrase>(?:(?:the|a|an)\s+)?[^,;:.]{2,140}?)\s+(?:commutes?|evolves?|satisfies|obeys|describes?|represents?|is|are|has|holds)\b", _I)),
    ("active_context_object", 82, re.compile(r"\b(?:we|one)\s+(?:can\s+|may\s+|then\s+)?(?:derive|obtain|define|construct|introduce|write|express|represent|formulate|yield|give|consider)\s+(?P<phrase>(?:(?:the|a|an)\s+)?[^,;:.]{2,150})", _I)),
    ("derived_object", 80, re.compile(r"\b(?:derive|obtain|yield|give)s?\s+(?P<phrase>(?:(?:the|a|an)\s+)?[^,;:.]{2,140})", _I)),
    ("explicit_description", 84, re.compile(r"\bEq(?:uation)?\.?\s*\(?\s*[^)\s]+\s*\)?\s+(?:defines|describes|represents|gives|corresponds\s+to)\s+(?P<phrase>[^,;:.]{2,140})", _I)),
    ("named_complement", 83, re.compile(r"\b(?:called|known\s+as|serves?\s+as|corresponds?\s+to)\s+(?P<phrase>(?:(?:the|a|an)\s+)?[^,;:.]{2,120})", _I)),
)
#: source strategies whose text may already be the phrase, and the score for that
WHOLE_SCORE, WHOLE_SOURCES = 95, ("anchor_subject", "anchor_object", "derived_object", "explicit_description")
SEGMENT_SCORE, WINDOW_SCORE, WIDEST_WINDOW = 35, 40, 5
SCIENCE_HEADS = frozenset("""
    amplitude basis channel coefficient condition constraint correlation covariance current density distribution dynamics
    energy entropy equation error evolution factor fidelity field force form formula function gain hamiltonian identity
    impedance index inequality interaction kernel lagrangian law matrix model motion operator potential probability
    propagator relation solution spectrum state time transformation vector wavefunction qubit
""".split())  # fmt: skip
FORBIDDEN_VERBS = frozenset("""
    am are be been being can called commute commutes apply applies calculate calculates construct constructs applying
    calculating constructing counting carrying introducing consist consists contain contains correspond corresponds could
    define defines denote denotes depend depends derive derives defining denoting deriving expand expands expanding
    describe describes evaluate evaluates evolve evolves give gives has have holds indicate indicates is lead leads may
    model models obey obeys obtain obtains perform performs quantize quantizes refer refers simplify simplifies using
    performing quantizing obtaining use uses write writes writing yielding taking resulting measuring observe observes
    note notes find finds see sees represent represents satisfies serve serves shall should was were will would yield
    yields
""".split())  # fmt: skip


def squeeze(text: str) -> str:
    return " ".join(text.split())


def lower_words(text: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(text)]


def trim(raw: str) -> str:
    """The phrase without what introduces it, what follows it, references and articles."""
    text = squeeze(raw)
    for lead in (DISCOURSE_PREFIX, LEADING_NOISE):
        text = lead.sub("", text)
    for edge in (CLAUSE_BOUNDARY, REFERENCE_BOUNDARY):
        text = text[: m.start()] if (m := edge.search(text)) else text
    text = TRAILING_REFERENCE.sub("", text).strip(" \t\r\n,;:.()")
    return LEADING_DROP.sub("", text).strip(" \t\r\n,;:.")


def reject_reasons(phrase: str, needs_head: bool = False) -> list[str]:
    """Why a phrase cannot stand for a concept, in a fixed order."""
    found = lower_words(phrase)
    head = not SCIENCE_HEADS.isdisjoint(found)
    latex = LATEX_COMMAND.search(phrase)
    letters = len(LETTER.findall(phrase)) if latex else 0
    other = sum(map(len, phrase.split())) - letters if latex else 0
    checks = {
        "too_short": len(found) < 2 and not head,
        "too_long": len(found) > MAX_WORDS,
        "contains_finite_or_context_verb": not FORBIDDEN_VERBS.isdisjoint(found),
        "contains_definition_or_relative_clause": CLAUSE_BOUNDARY.search(phrase),
        "contains_equation_reference": EQUATION_REFERENCE.search(phrase),
        "incomplete_or_invalid_edge": INCOMPLETE_EDGE.search(phrase),
        "unbalanced_delimiters": any(phrase.count(a) != phrase.count(b) for a, b in ("()", "{}", "[]")),
        "missing_science_head": needs_head and not head,
        "math_dominated": latex and (len(found) < 2 or other > 2 * letters),
    }
    return [name for name, hit in checks.items() if hit]


def candidate(raw: str, strategy: str, base: int, needs_head: bool = False) -> dict:
    phrase = trim(raw)
    found = lower_words(phrase)
    bonus = 10 * (not SCIENCE_HEADS.isdisjoint(found)) + 3 * (2 <= len(found) <= 8) - bool(LATEX_COMMAND.search(phrase))
    reasons = reject_reasons(phrase, needs_head)
    return {"raw": raw.strip(), "phrase": phrase, "strategy": strategy, "score": base + bonus, "accepted": not reasons, "reasons": reasons}


def matches(strategy: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """pattern.finditer(text).

    Where a phrase may begin with any word, only places that an end follows, near enough and with no mark between that
    a phrase cannot hold, are tried: all others fail. That holds for squeezed texts, whose articles have one space.
    """
    if strategy not in ENDS or squeeze(text) != text:
        yield from pattern.finditer(text)
        return
    ends, longest = ENDS[strategy]
    free = 0  # places before it are used or cannot match
    for end in ends.finditer(text):
        at = end.start()
        low = max(free, at - longest - 1 - ARTICLE, *(text.rfind(mark, free, at) + 1 for mark in ",;:"))
        found = next(filter(None, (pattern.match(text, k) for k in range(low, at))), None)
        free = max(free, at)
        if found:
            yield found
            free = found.end()


def from_templates(text: str) -> Iterator[dict]:
    """One candidate for each match of each template."""
    for strategy, score, pattern in TEMPLATES:
        yield from (candidate(m["phrase"], strategy, score) for m in matches(strategy, pattern, text))


def from_windows(text: str) -> Iterator[dict]:
    """Clauses of up to MAX_WORDS words, and the one to five words that end in a science head."""
    for clause in map(str.strip, SEGMENT_BREAK.split(text)):
        spans = [m.span() for m in WORD.finditer(clause)]
        if 0 < len(spans) <= MAX_WORDS:
            yield candidate(clause, "science_head_segment", SEGMENT_SCORE, True)
        for last, (a, b) in enumerate(spans):
            if clause[a:b].casefold() in SCIENCE_HEADS:
                for width in range(1, min(WIDEST_WINDOW, last + 1) + 1):
                    yield candidate(clause[spans[last - width + 1][0] : b], "science_head_window", WINDOW_SCORE + width, True)


def clean(text: str, source_strategy: str | None = None) -> dict:
    """The best phrase of a text with its audit (X19): meaning, applied, strategy, removed parts, candidates."""
    whole = squeeze(text)
    result = {"meaning": "", "applied": bool(whole), "strategy": "no_reliable_phrase" if whole else "empty_source", "removed_prefix": "", "removed_suffix": whole, "candidates": []}
    if not whole:
        return result
    if SYMBOL_DEFINITION_START.search(whole):
        result["candidates"] = [{"raw": whole, "phrase": "", "strategy": "symbol_definition_exclusion", "score": 0, "accepted": False, "reasons": ["symbol_definition_sentence"]}]
        return result
    found = [candidate(whole, "existing_phrase", WHOLE_SCORE)] if source_strategy in WHOLE_SOURCES else []
    found = [own for own in found if len(lower_words(own["phrase"])) <= MAX_WORDS]
    found += [*from_templates(whole), *from_windows(whole)]
    result["candidates"] = found
    best = max((c for c in found if c["accepted"]), key=lambda c: (c["score"], -len(lower_words(c["phrase"])), c["phrase"]), default=None)
    if best:
        phrase = best["phrase"]
        before, at, after = whole.partition(phrase)
        result |= {"meaning": phrase, "applied": phrase != whole, "strategy": best["strategy"], "removed_prefix": before.strip() if at else "", "removed_suffix": after.strip()}
    return result


def postprocess(meaning: str | None, strategy: str | None, source_text: str | None, earlier: dict | None = None) -> dict:
    """A record's meaning and audit after cleaning; the original is kept, and flagged, if no phrase is reliable.

    `earlier` is the audit of a previous run: its original meaning is cleaned again, so a second run changes nothing.
    """
    earlier = earlier or {}
    original = (earlier.get("original_meaning") if earlier.get("applied") else None) or meaning or ""
    done = clean(original, strategy)
    flagged = bool(original) and not done["meaning"]
    out = original if flagged else done["meaning"]
    return {
        "meaning": out, "applied": done["applied"] and not flagged, "flagged": flagged, "strategy": done["strategy"],
        "original_meaning": original if done["applied"] or flagged else None, "removed_prefix": done["removed_prefix"] or None,
        "removed_suffix": done["removed_suffix"] or None, "candidates": done["candidates"], "extractive": bool(out) and out in (source_text or ""),
    }

