"""Texts as units that a byte-level tokenizer treats one by one, and the values of distinct units for many texts at once.

A space that is followed by something other than white space always begins a match of the byte-level pattern: words,
numbers and signs take one space in front of them only, and a run of white space leaves its last space to what
follows. So a text can be cut before each such space and every unit be encoded by itself. Arrow cuts at all single
spaces and numbers the distinct strings; texts in which a string after a space is empty or begins with white space are
cut again, in Python, so that it stays with the unit before it.

Units are encoded once for as long as they stay in a bounded cache; the values of a text's units, which are arrays of
one type, are gathered in one step for all texts of a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries and characters of one generation of the cache; two are kept, and what is used again moves to the newer.
LIMIT = 400_000
LIMIT_CHARS = 8_000_000
#: Bytes of text whose units are numbered together (one text at least), and texts whose values are gathered together.
SLICE_BYTES, GATHERED = 8_000_000, 256


class UnitCache:
    """Distinct strings -> bytes, by `encode`, which takes a list of strings that are not known."""

    def __init__(self, encode: Callable[[list[str]], Sequence[bytes]]):
        self.encode = encode
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def values(self, strings: list[str]) -> list[bytes]:
        if len(self.newer) > LIMIT or self.chars > LIMIT_CHARS:
            self.older, self.newer, self.chars = self.newer, {}, 0
        newer, older = self.newer, self.older
        out = [newer.get(s) for s in strings]
        missing = [k for k, v in enumerate(out) if v is None]
        fresh = []
        for k in missing:
            s = strings[k]
            value = older.get(s)
            if value is None:
                fresh.append(k)
            else:
                out[k] = newer[s] = value
                self.chars += len(s)
        if fresh:
            wanted = [strings[k] for k in fresh]
            for k, s, value in zip(fresh, wanted, self.encode(wanted), strict=True):
                out[k] = newer[s] = value
            self.chars += sum(map(len, wanted))
        return out


def cut(text: str) -> list[str]:
    """The units of a text: it is cut before every space that something other than white space follows."""
    out: list[str] = []
    for part in text.split(" "):
        if out and (not part or part[0].isspace()):
            out[-1] += " " + part
        else:
            out.append(" " + part if out else part)
    return out


def _loose(words: pa.Array) -> np.ndarray:
    """Which of these strings are empty or begin with white space."""
    first = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
    space = np.array([not c or c.isspace() for c in first.dictionary.to_pylist()], bool)
    return space[first.indices.to_numpy()] if len(words) else np.zeros(0, bool)


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, number of each unit in turn, where each text begins and, last, the end); nulls count as empty."""
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat, starts = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    starts = starts - (starts[0] if len(starts) else 0)
    coded = flat.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    loose = _loose(coded.dictionary)[numbers] if len(flat) else np.zeros(0, bool)
    loose[starts[:-1]] = False
    again = np.flatnonzero(np.add.reduceat(loose, starts[:-1])) if loose.any() else np.zeros(0, np.int64)
    words = coded.dictionary.to_pylist()
    n = len(words)
    # The first unit of a text has no space before it: it is another string than the same word later on.
    heads = pc.take(flat, pa.array(starts[:-1])).dictionary_encode()
    strings = [" " + w for w in words] + heads.dictionary.to_pylist()
    numbers[starts[:-1]] = heads.indices.to_numpy() + n
    if len(again):
        known: dict[str, int] = {}
        parts, end = [], 0
        lengths = np.diff(starts)
        for k in again.tolist():
            own = [known.setdefault(u, len(strings) + len(known)) for u in cut(texts[k].as_py())]
            parts += [numbers[end : starts[k]], np.array(own, np.int64)]
            end, lengths[k] = starts[k + 1], len(own)
        numbers = np.concatenate([*parts, numbers[end:]])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        strings += list(known)
    return strings, numbers, starts


def gather(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[c]:starts[c + 1]] for c in chosen, one after the other, and where each one begins."""
    lengths = np.diff(starts)[chosen]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[:-1][chosen] - begins, lengths)], np.concatenate([begins, [total]])


class UnitStream:
    """The encoded values of texts, from one cache: little-endian unsigned 32-bit numbers, as `encode` gives them in bytes."""

    def __init__(self, encode: Callable[[list[str]], Sequence[bytes]]):
        self.cache = UnitCache(encode)

    def values(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time, in order: their values one after the other, and where each text's begin and, last, the end."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        strings, numbers, starts = units(texts)
        used = np.flatnonzero(np.bincount(numbers, minlength=len(strings)))
        number = np.zeros(len(strings), np.int64)
        number[used] = np.arange(len(used))
        found = self.cache.values([strings[k] for k in used.tolist()] if len(used) < len(strings) else strings)
        held = np.frombuffer(b"".join(found), "<u4")
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        del strings, found
        for k in range(0, len(starts) - 1, GATHERED):
            some = starts[k : k + GATHERED + 1]
            flat, begins = gather(held, ends, number[numbers[some[0] : some[-1]]])
            yield flat, begins[some - some[0]]
