"""License detection by ordered signature rules.

A text becomes its words in lower case with single spaces between. A rule is a regular expression over the words with
a priority and a weight: hand-written signatures of license texts, headers, notices and links (license_texts.py), and
FAMILIES' names in the FORMS in which a text brings a license in. A keyword prefilter, one Aho-Corasick pass, opens
the rules that can match: for each rule the strings that all its matches hold are read off the parsed expression, so
the prefilter hides no match. Detections that lie within an interval already taken by a rule of higher priority are
dropped, longer ones first among equals. All steps take time that grows with the text's length and its number of
detections, but for the logarithm of the latter.
"""

from __future__ import annotations

import re
import re._parser as parser
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import batch_of, map_batches, texts
from inkwell.llm.license_texts import signatures

#: (words of a phrase, label): counted wherever the words stand in a row.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, name as a regular expression over lower-case words); the group n is a version within the name.
FAMILIES = (
    ("mit", r"mit(?: x11| expat)?"),
    ("mit-0", r"mit no attribution"),
    ("expat", r"expat"),
    ("x11", r"x11"),
    ("apache", r"apache(?: software)?"),
    ("gpl", r"(?:gnu )?general public"),
    ("gpl", r"(?:gnu )?gpl(?:v(?P<n>[123]))?"),
    ("lgpl", r"(?:gnu )?lesser general public"),
    ("lgpl", r"(?:gnu )?library general public"),
    ("lgpl", r"(?:gnu )?lgpl(?:v(?P<n>[23]))?"),
    ("agpl", r"(?:gnu )?affero general public"),
    ("agpl", r"(?:gnu )?agpl(?:v(?P<n>[13]))?"),
    ("gfdl", r"(?:gnu )?free documentation"),
    ("bsd-2-clause", r"simplified bsd"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-3-clause", r"(?:new|revised|modified) bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", r"0bsd"),
    ("0bsd", r"zero clause bsd"),
    ("bsd", r"bsd(?: style)?"),
    ("mpl", r"mozilla public"),
    ("mpl", r"mpl"),
    ("epl", r"eclipse public"),
    ("epl", r"epl"),
    ("edl", r"eclipse distribution"),
    ("cddl", r"cddl"),
    ("cddl", r"common development and distribution"),
    ("cpl", r"common public"),
    ("cpal", r"common public attribution"),
    ("ipl", r"ibm public"),
    ("eupl", r"eupl"),
    ("eupl", r"european union public"),
    ("osl", r"open software"),
    ("afl", r"academic free"),
    ("ecl", r"educational community"),
    ("artistic", r"artistic"),
    ("bsl", r"boost software"),
    ("isc", r"isc"),
    ("isc", r"internet systems consortium"),
    ("zlib", r"(?:zlib|zlib libpng)"),
    ("libpng", r"libpng"),
    ("unlicense", r"(?:the )?unlicense"),
    ("wtfpl", r"wtfpl"),
    ("cc0", r"(?:cc0|cc 0)"),
    ("cc0", r"creative commons zero"),
    ("cc-by", r"cc by"),
    ("cc-by-sa", r"cc by sa"),
    ("cc-by-nd", r"cc by nd"),
    ("cc-by-nc", r"cc by nc"),
    ("cc-by-nc-sa", r"cc by nc sa"),
    ("cc-by-nc-nd", r"cc by nc nd"),
    ("cc-by", r"creative commons attribution"),
    ("cc-by-sa", r"creative commons attribution (?:sharealike|share alike)"),
    ("cc-by-sa", r"creative commons attribution share alike"),
    ("cc-by-nc", r"creative commons attribution noncommercial"),
    ("cc-by-nc", r"creative commons attribution non commercial"),
    ("cc-by-nd", r"creative commons attribution noderivatives"),
    ("cc-by-nc-sa", r"creative commons attribution noncommercial (?:sharealike|share alike)"),
    ("cc-by-nc-nd", r"creative commons attribution noncommercial (?:noderivatives|no derivatives)"),
    ("cc", r"creative commons"),
    ("odbl", r"odbl"),
    ("odbl", r"open database"),
    ("odc-by", r"odc by"),
    ("pddl", r"pddl"),
    ("ofl", r"(?:sil )?open font"),
    ("python", r"(?:python software foundation|psf)"),
    ("python", r"python"),
    ("php", r"php"),
    ("ruby", r"ruby"),
    ("perl", r"perl(?: 5)?"),
    ("postgresql", r"postgresql"),
    ("openssl", r"openssl"),
    ("curl", r"curl"),
    ("ncsa", r"(?:university of illinois ncsa|ncsa)(?: open source)?"),
    ("ms-pl", r"microsoft public"),
    ("ms-rl", r"microsoft reciprocal"),
    ("apsl", r"apple public source"),
    ("sissl", r"sun industry standards source"),
    ("npl", r"netscape public"),
    ("qpl", r"q public"),
    ("lppl", r"latex project public"),
    ("sspl", r"server side public"),
    ("busl", r"business source"),
    ("elastic", r"elastic"),
    ("commons-clause", r"commons clause"),
    ("mulan", r"mulan (?:permissive software|psl)"),
    ("cecill", r"cecill"),
    ("proprietary", r"proprietary"),
    ("llama", r"llama(?: [23])? community"),
    ("openrail", r"(?:open ?rail|creativeml open rail|bigscience open rail) ?m?"),
)

VERSION = r"(?: (?:version |v ?)?(?P<v>\d+(?: \d+)?)(?: (?:or later|only|unported|international|generic))?)?"
WORD = r"(?: licen[cs]e)?"
#: (priority, weight, form around a name)
FORMS = (
    (5, 1.0, r"spdx licen[cs]e identifier {name}" + VERSION),
    (4, 0.95, r"(?:re)?(?:licensed|licenced|released|distributed|published|provided|available|redistributed) under (?:the )?(?:terms of (?:the )?)?{name}" + WORD + VERSION),
    (3, 0.9, r"(?:subject to|governed by|covered by|conditions of|copy of|accordance with|compliance with|dual licensed) (?:the )?{name} licen[cs]e" + VERSION),
    (2, 0.85, r"{name}(?: v?\d+(?: \d+)?)? (?:public )?licen[cs]es?" + VERSION),
    (1, 0.6, r"(?:licen[cs]e|licen[cs]ed as) {name}" + VERSION),
)


Rule = tuple[int, float, str, re.Pattern, tuple[frozenset[str], ...]]


def _needed(tree, literal: str = "") -> tuple[list[frozenset[str]], str | None]:
    """What every match of a parsed expression holds: sets of strings of which one each must occur, and the whole match if it is one string."""
    sets: list[frozenset[str]] = []
    run, exact = literal, True

    def close() -> None:
        nonlocal run
        if run.strip():
            sets.append(frozenset((run,)))
        run = ""

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        inner = None
        if name == "SUBPATTERN":
            inner, whole = _needed(arg[-1])
            if whole is not None:
                run += whole
                continue
        exact = False
        close()
        if name == "SUBPATTERN":
            sets += inner
        elif name == "BRANCH":
            best = [max(_needed(branch)[0], key=_weight, default=None) for branch in arg[1]]
            if None not in best:
                sets.append(frozenset().union(*best))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]:
            sets += _needed(arg[2])[0]
    whole = run if exact else None
    close()
    return sets, whole


def _weight(strings: frozenset[str]) -> tuple[int, int]:
    """Telling sets first: those whose shortest string is longest."""
    return min(map(len, strings)), -len(strings)


def needed(expression: str) -> tuple[frozenset[str], ...]:
    """Sets of strings of which every match, with the spaces around it, holds one each; short strings only if need be."""
    tree = list(parser.parse(expression))
    space = (parser.LITERAL, 32) if hasattr(parser, "LITERAL") else tree[0]
    sets, _ = _needed([space, *tree, space])
    ranked = sorted(sets, key=_weight, reverse=True)
    return tuple(x for k, x in enumerate(ranked) if not k or min(len(y.strip()) for y in x) > 2)


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """(priority, weight, label, expression over words, what it needs), in the order in which they apply."""
    made = [(p, w, label, form.replace("{name}", name)) for label, name in FAMILIES for p, w, form in FORMS]
    made += [(p, w, label, text) for label, text, p, w in signatures()]
    return [(p, w, label, re.compile(rf"(?<![^ ])(?:{text})(?![^ ])"), needed(text)) for p, w, label, text in sorted(made, key=lambda r: -r[0])]


@lru_cache(maxsize=1)
def prefilter():
    """Automaton over all strings that rules need; by string, the rules whose most telling set has it; their other sets."""
    import ahocorasick

    numbers: dict[str, int] = {}
    for *_, sets in rules():
        for strings in sets:
            for x in strings:
                numbers.setdefault(x, len(numbers))
    automaton = ahocorasick.Automaton()
    for x, k in numbers.items():
        automaton.add_word(x, k)
    automaton.make_automaton()
    by_string: dict[int, list[int]] = {}
    others = []
    for r, (*_, sets) in enumerate(rules()):
        for x in sets[0]:
            by_string.setdefault(numbers[x], []).append(r)
        others.append([frozenset(numbers[x] for x in strings) for strings in sets[1:]])
    return automaton, by_string, others


def opened(words: str) -> list[int]:
    """Numbers of the rules that may match, in a text from normalise()."""
    automaton, by_string, others = prefilter()
    seen = {k for _, k in automaton.iter(words)}
    first = {r for k in seen for r in by_string.get(k, ())}
    return sorted(r for r in first if not any(seen.isdisjoint(x) for x in others[r]))


_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str) -> str:
    """The words of a text, A-Z in lower case, single spaces between and around them."""
    words = text.encode().translate(_TO_WORDS).split()
    return f" {b' '.join(words).decode()} " if words else " "


def word_numbers(words: str, places: Iterable[int]) -> dict[int, int]:
    """For places in a text from normalise(): how many spaces there are before each, in one pass."""
    out, at, n = {}, 0, 0
    for place in sorted(set(places)):
        n += words.count(" ", at, place)
        out[place], at = n, place
    return out


def base_places(words: str) -> list[tuple[int, str]]:
    """(first word, label) for every place of a base phrase, in a text from normalise()."""
    found = []
    for phrase, label in BASE_PHRASES:
        at = words.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = words.find(f" {phrase} ", at + 1)
    number = word_numbers(words, (at for at, _ in found))
    return [(number[at], label) for at, label in found]


def _outermost(found: list[tuple]) -> list[tuple]:
    """Those of (..., start, end, label, weight) in this order that do not lie within an earlier one that was kept."""
    starts = sorted({x[2] for x in found})
    reach = [0] * (len(starts) + 1)  # a Fenwick tree of the largest end of those kept, by start
    kept = []
    for x in found:
        start, end = x[2], x[3]
        k = bisect_right(starts, start)
        at, most = k, 0
        while at:
            most = max(most, reach[at])
            at -= at & -at
        if most >= end:
            continue
        kept.append(x)
        while k < len(reach):
            reach[k] = max(reach[k], end)
            k += k & -k
    return kept


def detections(words: str, numbers: list[int] | None = None) -> list[tuple[int, int, str, float]]:
    """(first word, one past the last, label, weight) that survive, in a text from normalise().

    `numbers` are those of the rules to try; by default those that the prefilter opens.
    """
    found = []
    for k in opened(words) if numbers is None else numbers:
        priority, weight, label, expression, _ = rules()[k]
        for m in expression.finditer(words, 1, len(words) - 1):
            groups = m.groupdict()
            version = groups.get("v") or groups.get("n")
            found.append((-priority, m.start() - m.end(), m.start(), m.end(), label + (f"-{version.replace(' ', '.')}" if version else ""), weight))
    if not found:
        return []
    kept = sorted((start, end, label, weight) for _, _, start, end, label, weight in _outermost(sorted(found)))
    number = word_numbers(words, (x for a, b, *_ in kept for x in (a, b)))
    return [(number[a] - 1, number[b], label, weight) for a, b, label, weight in kept]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, the base phrases' places, and the labels of base phrases and rules together.

    score is the chance that at least one detection holds, taking their weights (0.9 for a base phrase) as
    independent; 0 without any. A null text counts as empty; a text may be as long as a cell can be. Detections that
    tie in priority, length and place are settled by label. Repeated rows are scanned each for itself; other columns,
    whatever their names, are not read; an empty table gives an empty result. `spans` lists the rules' detections as
    first_word-end_word:label.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts(batch):
            words = normalise(text)
            base = base_places(words) if "license" in words else []
            found = detections(words)
            miss = 1.0
            for weight in [0.9] * len(base) + [d[3] for d in found]:
                miss *= 1 - weight
            starts = [at for at, _ in base]
            names = {label for _, label in base}
            rows.append((words.count(" ") - 1, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {d[2] for d in found})), round(1 - miss, 6), ",".join(f"{a}-{b}:{label}" for a, b, label, _ in found)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
        return batch_of(doc_id=batch.column("doc_id"), **{n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return map_batches(plain, lambda: work, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
