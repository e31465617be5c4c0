"""The prefilter hides no rule, scanning takes linear time, and labels and scores agree with a plain scan of all rules."""

from __future__ import annotations

import random
import re._parser as parser
import time
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from inkwell.llm import licenses

ALL = lru_cache(lambda: list(range(len(licenses.rules()))))


def spelling(tree, r):
    """A text that the parsed expression matches, with branches, options and classes chosen at random."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            o, v = r.choice(arg)
            out.append(chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else str(r.randint(1, 9)))
        elif name == "ANY":
            out.append("x")
        elif name == "SUBPATTERN":
            out.append(spelling(arg[-1], r))
        elif name == "BRANCH":
            out.append(spelling(r.choice(arg[1]), r))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += [spelling(inner, r) for _ in range(r.randint(low, min(high, low + 1, 4)))]
        else:
            assert name in ("ASSERT_NOT",), name
    return "".join(out)


def test_every_spelling_opens_its_rule():
    r = random.Random(3)
    for k, (_, _, label, expression, needed) in enumerate(licenses.rules()):
        tree = parser.parse(expression.pattern)
        assert needed, expression.pattern
        for _ in range(12):
            text = f" filler words {spelling(tree, r)} more filler "
            assert expression.search(text, 1, len(text) - 1), (label, text)
            assert k in licenses.opened(text), (label, text)


def plain(words):
    """All rules over the text, an interval being dropped if one that comes before it and stays holds it."""
    found = []
    for priority, weight, label, expression, _ in licenses.rules():
        for m in expression.finditer(words, 1, len(words) - 1):
            groups = m.groupdict()
            version = groups.get("v") or groups.get("n")
            found.append((-priority, m.start() - m.end(), m.start(), m.end(), label + (f"-{version.replace(' ', '.')}" if version else ""), weight))
    kept = []
    for x in sorted(found):
        if not any(k[2] <= x[2] and x[3] <= k[3] for k in kept):
            kept.append(x)
    return sorted((words[: x[2]].count(" ") - 1, words[: x[3]].count(" "), x[4], x[5]) for x in kept)


def test_scans_agree_with_a_plain_scan(spark, sf_dir):
    r = random.Random(4)
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60]
    for _ in range(60):
        parts = [spelling(parser.parse(r.choice(licenses.rules())[3].pattern), r) for _ in range(r.randint(1, 5))]
        texts.append(" and ".join(parts) + r.choice(["", " mit license", "\nApache License, version 2"]))
    rows = {x["doc_id"]: x for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        words = licenses.normalise(text or "")
        want = plain(words)
        assert sorted(licenses.detections(words)) == want
        base = licenses.base_places(words)
        miss = 1.0
        for weight in [0.9] * len(base) + [d[3] for d in want]:
            miss *= 1 - weight
        assert rows[k]["labels"] == ",".join(sorted({d[2] for d in want} | {b for _, b in base}))
        assert rows[k]["score"] == pytest.approx(1 - miss, abs=1e-6)


def test_long_texts_take_linear_time():
    def took(n):
        words = licenses.normalise("the mit license and " * n)
        start = time.process_time()
        assert len(licenses.base_places(words)) == n and len(licenses.detections(words)) == n
        return time.process_time() - start

    took(1000)
    assert took(80_000) < 16 * max(took(10_000), 0.02)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("released under the GPL version 3", "gpl-3"),
        ("released under the GPL v3", "gpl-3"),
        ("available under CC BY 4.0", "cc-by-4.0"),
        ("License: GPLv3", "gpl-3"),
        ("distributed under Apache 2.0", "apache-2.0"),
        ("available under the MPL", "mpl"),
        ("licensed under GPLv3", "gpl-3"),
        ("licensed under the LGPLv2", "lgpl-2"),
        ("the LGPLv2.1 license", "lgpl-2"),
        ("Licensed under the CreativeML Open RAIL-M", "openrail"),
        ("Licensed under BigScience Open RAIL-M", "openrail"),
        ("Python Software Foundation License", "python"),
        ("Modified BSD License", "bsd-3-clause"),
        ("licensed under CC 0", "cc0"),
        ("See http://www.apache.org/licenses/LICENSE-2.0 for it", "apache-2.0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("You should have received a copy of the GNU Affero General Public License along with this", "agpl"),
    ],
)
def test_common_spellings(text, label):
    assert label in {d[2] for d in licenses.detections(licenses.normalise(text))}
