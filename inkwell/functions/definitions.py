"""Definitions of symbols in sentences, in three variants that share building blocks.

`cue` and `cue_strict` take the first of an ordered list of patterns whose capture is a valid definition; `retrieval`
tries five extractors over ranked sentences.
"""

from __future__ import annotations

import re
from functools import lru_cache

_I = re.IGNORECASE

# Patterns, word lists and limits that decide the results. {alias} is the symbol's alternatives.
VAGUE = re.compile(r"^(?:it|this|that|these|those|aforementioned|the\s+(?:same|above|following))\b", _I)
PROPERTY = re.compile(r"^(?:applied|discretized|equal\s+to|fully\s+characterized|given\s+by|held\s+fixed|implemented|irreducible|less\s+than|more\s+likely|much\s+less|in\s+Eq\b|non-?zero\b|on\s+the|provided|proportional\s+to|real\b|sufficiently\s+small)", _I)
HERE_WE = re.compile(r"\b(?:Here|Where),?\s+we\b")
COORDINATION = re.compile(r"(?:,\s+(?:and\s+)?|\s+and\s+)(?:\\?[A-Za-z][^,]{0,45}?)\s+(?:is|are|denotes?|represents?)\b", _I)
ARTICLE = re.compile(r"^(?:the|a|an)\s+", _I)
DEFINITION_WORD = re.compile(r"[A-Za-z][A-Za-z0-9'-]*")
MATH_CHARACTERS, MATH_SHARE, MOST_WORDS = frozenset("\\{}_^="), 0.35, 30
CUE_PATTERNS = (
    ("symbol_before_cue", r"(?P<alias>{alias})\s*(?:,?\s*)(?:denotes?|represents?|means?|refers?\s+to|stands?\s+for|is\s+defined\s+as|are\s+defined\s+as)\s+(?P<definition>[^.;]{1,220})"),
    ("contextual_copula", r"\b(?:where|here|with)\b\s*[^.;]{0,180}?(?P<alias>{alias})\s+(?:is|are)\s+(?P<definition>[^.;]{1,220})"),
    ("initial_copula", r"^\s*(?P<alias>{alias})\s+(?:is|are)\s+(?P<definition>(?:the|a|an)\s+[^.;]{1,220})"),
    ("definition_before_symbol", r"(?:we\s+)?(?:denote|represent|define|write)\s+(?P<definition>[^.;]{1,220}?)\s+(?:as|by)\s+(?P<alias>{alias})"),
    ("passive_definition", r"(?P<definition>[^.;]{1,180}?)\s+(?:is|are)\s+(?:denoted|represented|defined)\s+(?:by|as)\s+(?P<alias>{alias})"),
)
STOP_WORDS = frozenset("""
    a an the this that these those is are was were be been being have has had do does did will would could should may
    might shall can and or but for at by in on to of up as if it its we they them their with from not all any both each
    few more most other some such than then too very
""".split())  # fmt: skip
SPAN_MOST_WORDS, SPAN_LEAST_WORDS, COMMAND_SHARE = 20, 2, 0.5
SPAN_END = re.compile(r"[.;]|\s+where\s+|\s+and\s+(?=\\|[A-Za-z_]+\s+(?:is|are|denotes?))")
#: (name, confidence, pattern, whether the span is the group before the symbol), then that of aligned lists
SPAN_PATTERNS = (
    ("where_is", 1.0, r"\bwhere\s+(?:{alias})\s+(?:is|are)\s+", False),
    ("denotes", 0.9, r"(?:^|(?<=\s)|(?<=\())(?:{alias})\s+(?:denotes?|represents?)\s+", False),
    ("let_be", 0.8, r"\blet\s+(?:{alias})\s+(?:be|denote)\s+", False),
    ("reverse_np", 0.65, r"\b((?:the\s+)?(?:[A-Za-z][A-Za-z-]*\s+){1,5})(?:{alias})(?=\s|[,.;)]|$)", True),
)
RESPECTIVELY = ("respectively", 0.75)
LISTED = re.compile(r"\bare\s+(?:the\s+)?(.*?)\s*,?\s*respectively", _I)
LIST_BREAK = re.compile(r"\s+and\s+|,\s*")
#: the second generation of cues: as CUE_PATTERNS, with a form and two verbs more
CUE_PATTERNS_2 = (
    *CUE_PATTERNS[:3],
    ("let_be", r"\blet\s+(?P<alias>{alias})\s+be\s+(?P<definition>[^.;]{1,220})"),
    ("definition_before_symbol", r"(?:we\s+)?(?:denote|represent|define|write|call)\s+(?P<definition>[^.;]{1,220}?)\s+(?:as|by)\s+(?P<alias>{alias})"),
    ("passive_definition", r"(?P<definition>[^.;]{1,180}?)\s+(?:is|are)\s+(?:denoted|represented|defined|called)\s+(?:by|as)\s+(?P<alias>{alias})"),
)


@lru_cache(maxsize=4096)
def alias_pattern(aliases: tuple[str, ...]) -> str:
    """Alternatives, longest first, that must not run on into letters or digits; empty without aliases."""
    def guarded(a: str) -> str:
        return ("(?<![A-Za-z0-9])" if a[0].isalnum() else "") + re.escape(a) + ("(?![A-Za-z0-9_^])" if a[-1].isalnum() else "")

    named = sorted({a.strip() for a in aliases} - {""}, key=lambda a: (-len(a), a))
    return f"(?:{'|'.join(map(guarded, named))})" if named else ""


def mentions(text: str, aliases: tuple[str, ...]) -> bool:
    pattern = alias_pattern(aliases)
    return bool(pattern and re.search(pattern, text))


def tidy(definition: str) -> str:
    """Up to where the next definition is joined on, without an article."""
    text = " ".join(definition.split()).strip(" \t,;:.()")
    return ARTICLE.sub("", COORDINATION.split(text, maxsplit=1)[0]).strip()


def is_valid(definition: str, aliases: tuple[str, ...]) -> bool:
    """A description in words, neither vague nor a property, balanced and not mostly mathematics."""
    n = len(DEFINITION_WORD.findall(definition))
    if not 1 <= n <= MOST_WORDS or any(p.search(definition) for p in (VAGUE, PROPERTY, HERE_WE)):
        return False
    if definition.casefold() in {a.strip().casefold() for a in aliases}:
        return False
    share = sum(c in MATH_CHARACTERS for c in definition) / max(1, len(definition))
    return share <= MATH_SHARE and all(definition.count(a) == definition.count(b) for a, b in ("()", "[]", "{}"))


def define_by_cue(text: str, aliases: tuple[str, ...], patterns: tuple = CUE_PATTERNS) -> tuple[str, str, str]:
    """(definition, strategy, alias) by the first pattern with a valid capture, else empty with no_pattern (X11)."""
    alias = alias_pattern(aliases)
    for strategy, pattern in patterns if alias else ():
        m = re.search(pattern.replace("{alias}", alias), text, _I)
        if m:
            raw = m["definition"]
            if strategy == "definition_before_symbol" and " as " in raw:
                raw = re.split(r"\band\b", raw, flags=_I)[-1]
            if is_valid(definition := tidy(raw), aliases):
                return definition, strategy, m["alias"]
    return "", "no_pattern", ""


def span_alias(alias: str) -> str:
    """One alias as a pattern: a command must end, a name stands between word boundaries."""
    escaped = re.escape(alias)
    if alias.startswith("\\"):
        return escaped.replace(r"\{", r"\{?").replace(r"\}", r"\}?") + "(?![A-Za-z])"
    return rf"\b{escaped}\b" if re.fullmatch("[A-Za-z0-9_]+", alias) else escaped


@lru_cache(maxsize=4096)
def symbol_pattern(aliases: tuple[str, ...]) -> str:
    """All aliases of a symbol, in the order given."""
    return "|".join(dict.fromkeys(span_alias(a) for a in aliases if a))


def valid_span(span: str, latex: str) -> bool:
    """At most 20 words, at least two of them meaningful, no environment, not part of the equation."""
    span = span.strip()
    n = len(span.split())
    meaningful = sum(w.lower() not in STOP_WORDS for w in re.findall("[A-Za-z]+", span))
    commands = len(re.findall(r"\\[A-Za-z]+", span))
    return bool(span) and n <= SPAN_MOST_WORDS and meaningful >= SPAN_LEAST_WORDS and r"\begin{" not in span and not (latex and span in latex) and not (commands and commands > max(n, 1) * COMMAND_SHARE)


def span_from(text: str) -> str:
    """The start of a text up to the end of the definition."""
    text = text.strip(" ,;:.")
    m = SPAN_END.search(text)
    return (text[: m.start()] if m else text).strip(" ,;:.")


def define_respectively(text: str, aliases: tuple[str, ...], others: list[tuple[str, ...]], latex: str) -> str | None:
    """The k-th definition for the symbol that is k-th among those before `respectively`."""
    own, end = re.search(symbol_pattern(aliases), text), re.search(r"\brespectively\b", text, _I)
    listed = LISTED.search(text)
    if not own or not end or own.end() > end.start() or not listed:
        return None
    firsts = (re.search(symbol_pattern(a), text[: end.start()]) for a in others if symbol_pattern(a))
    places = sorted({m.start() for m in firsts if m})
    k = places.index(own.start()) if own.start() in places else 0
    parts = [p for p in (x.strip(" ,") for x in LIST_BREAK.split(listed[1])) if p]
    return parts[k] if k < len(parts) and valid_span(parts[k], latex) else None


def define_by_span(text: str, aliases: tuple[str, ...], latex: str = "", others: list[tuple[str, ...]] = ()) -> tuple[str, str, float] | None:
    """(span, extractor, confidence) by the first extractor that finds a valid one."""
    pattern = symbol_pattern(aliases)
    if not pattern:
        return None
    for name, confidence, shape, before in SPAN_PATTERNS:
        m = re.search(shape.replace("{alias}", pattern), text, _I)
        span = (m[1].strip() if before else span_from(text[m.end() :])) if m else ""
        if span and valid_span(span, latex):
            return span, name, confidence
    span = define_respectively(text, aliases, list(others), latex)
    return (span, *RESPECTIVELY) if span else None


def find_definition(sentences: list[str], aliases: tuple[str, ...], latex: str = "", others: list[tuple[str, ...]] = ()) -> tuple[str, str, float, int] | None:
    """(span, extractor, confidence, place) from the first of the ranked sentences that has one."""
    for k, s in enumerate(sentences):
        if found := define_by_span(s, aliases, latex, others):
            return (*found, k)
    return None
