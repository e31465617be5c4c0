"""Secrets in texts: three fixed patterns, and high-entropy strings found with a sliding window.

A candidate is a run of 20 or more characters of the base-64 alphabets. Its class (hexadecimal, letters and digits,
base 64) sets the threshold for the Shannon entropy of each window of WINDOW characters. The entropy is kept up by
counts: moving the window by one place changes two counts, so a candidate costs time in its length only. The windows
above the threshold, joined, are the span. An allow list suppresses what is known not to be secret: words without
digits, UUIDs, placeholders, runs of the alphabet, digests that the text names as such, addresses and paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import batch_of, map_batches, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: (class, its characters, bits per character that a window must reach)
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.5), ("base64", re.compile(r".+"), 3.7))
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|(?i:.*(?:example|sample|dummy|placeholder|changeme|redacted|x{6}|abcdefgh|qwerty|12345678|loremipsum).*)"
    r"|[A-Za-z]+(?:[-_/][A-Za-z]+)*"  # words and paths of words
    r"|[0-9]+(?:[-/_][0-9]+)*"  # numbers, dates
)
NAMED_DIGEST = re.compile(r"(?i)(?:commit|sha-?1|sha-?256|sha-?512|md5|checksum|digest|etag|revision)\W{0,4}$")
#: No name with what may follow it is longer.
NAMED = len("checksum") + 4
DIGIT = re.compile(r"[0-9]")
ADDRESS = re.compile(r"(?i)https?://|www\.")
#: Strings without white space that are long enough to hold a candidate.
LONG = re.compile(r"\S{20,}")
_TERM = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def window_entropies(s: str, width: int = WINDOW) -> Iterator[float]:
    """Shannon entropy, in bits per character, of every window of `width` characters, from running counts."""
    term = _TERM if width <= WINDOW else [0.0] + [n * log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, top = 0.0, log2(width)
    for k, c in enumerate(s):
        if k >= width:
            old = s[k - width]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if k >= width - 1:
            yield top - total / width


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy that the allow list does not know; time and memory grow with the text's length only."""
    out = []
    for long in LONG.finditer(text):
        address = ADDRESS.search(text, long.start(), long.end())
        for m in CANDIDATE.finditer(text, long.start(), long.end()):
            if address and address.end() <= m.start():
                break  # part of an address, and so is all that follows it
            s = m.group()
            if ALLOWED.fullmatch(s) or not DIGIT.search(s) or NAMED_DIGEST.search(text[max(0, m.start() - NAMED) : m.start()]):
                continue
            limit = next(limit for _, shape, limit in CLASSES if shape.fullmatch(s))
            first = last = -1
            for k, h in enumerate(window_entropies(s)):
                if h >= limit:
                    first, last = k if first < 0 else first, k
            if last >= 0:
                out.append((m.start() + first, m.start() + last + WINDOW))
    return out


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind in KINDS, end) in order; entropy spans only where they meet no other."""
    lower = text.lower()
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8] if any(w in lower for w in ("passw", "secret", "token", "api")) else []
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more, at, reach = [], 0, 0  # spans of both lists are in order; `reach` is the furthest end of the base spans so far
    for a, b in entropy_spans(text):
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            more.append((a, 3, b))
    return sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every text.

    Places are in code points, ends exclusive; base_sha256 digests the spans of the three patterns. A null text
    counts as empty; a text may be as long as a cell can be. Spans that begin together are listed as KINDS lists
    them. Repeated rows are scanned each for itself; other columns, whatever their names, are not read; an empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_secrets(t) for t in texts(batch)]
        count = lambda k: pa.array([sum(x[1] == k for x in spans) for spans in found], pa.int64())
        digest = [hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
        return batch_of(doc_id=batch.column("doc_id"), n_assign=count(0), n_access=count(1), n_hex=count(2), n_entropy=count(3), base_sha256=pa.array(digest, pa.string()), spans=pa.array(map(_joined, found), pa.string()))

    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return map_batches(plain, lambda: work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text or not (spans := find_secrets(text)):
        return text
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the redacted text of every row, all other columns as they are; nulls stay null."""
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([column if k == at else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return map_batches(docs, lambda: work, docs.schema)
