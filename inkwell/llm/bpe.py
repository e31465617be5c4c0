"""Byte-level BPE by merge replay over the words of many texts at once.

Each task takes its share of the corpus in slices of many megabytes, numbers the distinct words of a slice, and replays
the merges over all that are new to it together, in blocks of BLOCK_BYTES: an inverted index holds, for every mergeable
pair, the places where it stands; the pair of the lowest rank is merged at all its places, and only the neighbours of
a merged place enter the index again. Encoded words are kept in a bounded cache, and texts are put together from their
words' ids. One index over the words of the whole corpus would need its vocabulary, which grows with the corpus, in
one place, or every word of every text in a shuffle; this way there is none, any skew in the rows is harmless, and a
lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkwell.llm.common import batch_of, map_whole_batches
from inkwell.llm.pieces import UnitStream, gather

#: Bytes of words over which one inverted index is held (one word at least); it takes about 130 times as many.
BLOCK_BYTES = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gpt_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words together; `ranks` maps a token's bytes to its rank, which is also its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.pairs: dict[int, int] = {}
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, in the order of `words`."""
        flat, starts = self.encode_flat(words)
        ids, bounds = flat.tolist(), starts.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and where each word's begin and, last, the end; block by block."""
        whole = [self.ranks.get(w) for w in words]
        todo = [k for k, r in enumerate(whole) if r is None and words[k]]
        counts = np.array([r is not None for r in whole], np.int64)
        parts, at = [], 0
        while at < len(todo):
            stop, held = at, 0
            while stop < len(todo) and (stop == at or held + len(words[todo[stop]]) <= BLOCK_BYTES):
                held += len(words[todo[stop]])
                stop += 1
            ids, lengths = self._replay([words[k] for k in todo[at:stop]])
            parts.append(ids)
            counts[todo[at:stop]] = lengths
            at = stop
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(starts[-1]), np.int64)
        single = np.array([k for k, r in enumerate(whole) if r is not None], np.int64)
        out[starts[single]] = [r for r in whole if r is not None]
        if parts:
            rest = np.ones(len(out), bool)
            rest[starts[single]] = False
            out[rest] = np.concatenate(parts)
        return out, starts

    def _rank(self, a: int, b: int) -> int:
        """Rank of the token that a and b make together, or -1."""
        rank = self.pairs[a << 20 | b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are no tokens, and how many each has: the lowest rank merges first, leftmost first."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths) - 1
        n = len(data)
        found = np.full(n, -1)
        found[:-1] = self.byte_pairs[data[:-1] * 256 + data[1:]]
        found[ends] = -1
        ranked = np.argsort(found, kind="stable")
        values, starts = np.unique(found[ranked], return_index=True)
        index = {int(r): ranked[i:j].tolist() for r, i, j in zip(values, starts, [*starts[1:], n], strict=True) if r >= 0}
        links = np.arange(1, n + 1)
        links[ends] = -1
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[ends[:-1] + 1] = -1
        before = links.tolist()
        symbol = self.single[data].tolist()
        owner = np.repeat(np.arange(len(words)), lengths).tolist()
        known, rank_of = self.pairs.get, self._rank
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places, later, waiting = index.pop(rank), [], -1
            if len(places) > 1:
                places.sort()
            for p in places:
                a = symbol[p]
                q = after[p]
                if a < 0 or q < 0:
                    continue
                at = known(a << 20 | symbol[q])
                if at is None:
                    at = rank_of(a, symbol[q])
                if at != rank:
                    continue
                if waiting >= 0 and owner[p] == waiting:
                    later.append(p)
                    continue
                symbol[p], symbol[q] = rank, -1
                beyond = after[p] = after[q]
                if beyond >= 0:
                    before[beyond] = p
                    b = symbol[beyond]
                    fresh = known(rank << 20 | b)
                    if fresh is None:
                        fresh = rank_of(rank, b)
                    if fresh >= 0:
                        if fresh <= rank:
                            waiting = owner[p]
                        if fresh == rank:
                            later.append(p)
                        elif fresh in index:
                            index[fresh].append(p)
                        else:
                            index[fresh] = [p]
                            heappush(queue, fresh)
                left = before[p]
                if left >= 0:
                    a = symbol[left]
                    fresh = known(a << 20 | rank)
                    if fresh is None:
                        fresh = rank_of(a, rank)
                    if fresh >= 0:
                        if fresh <= rank:
                            waiting = owner[p]
                        if fresh == rank:
                            later.append(left)
                        elif fresh in index:
                            index[fresh].append(left)
                        else:
                            index[fresh] = [left]
                            heappush(queue, fresh)
            if later:
                index[rank] = later
                heappush(queue, rank)
        final = np.array(symbol)
        alive = np.flatnonzero(final >= 0)
        return final[alive], np.bincount(np.array(owner)[alive], minlength=len(words))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def unit_encoder(replay: MergeReplay, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes units (see pieces): all their matches of the pattern are numbered, and the distinct ones encoded together."""
    import regex

    find = regex.compile(pattern).findall

    def encode(units: list[str]) -> list[bytes]:
        split = [find(u) for u in units]
        coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        ids, starts = replay.encode_flat([w.encode() for w in coded.dictionary.to_pylist()])
        flat, begins = gather(ids.astype("<u4"), starts, coded.indices.to_numpy().astype(np.int64))
        data = flat.tobytes()
        bounds = (begins[np.cumsum([0, *map(len, split)])] * 4).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    return encode


class TextCoder:
    """Encodes texts whole and decodes the ids."""

    def __init__(self, path: str, pattern: str):
        replay = MergeReplay(load_ranks(path))
        self.stream = UnitStream(unit_encoder(replay, pattern))
        top = max(replay.tokens) + 1
        self.decimals = pa.array([str(i) for i in range(top)])
        self.tokens = pa.array([replay.tokens.get(i, b"") for i in range(top)], pa.binary())

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.stream.values(texts)

    def written(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """For each text: its ids as decimals with single spaces, and its decoded bytes."""
        chosen, offsets = pa.array(ids.astype(np.int32)), pa.array(starts.astype(np.int32))
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(chosen)), sep) for table, sep in ((self.decimals, " "), (self.tokens, b""))]
        for a, b in zip(*joined, strict=True):
            yield a.as_buffer().to_pybytes(), b.as_buffer().to_pybytes()


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded whole and decoded again.

    A null text counts as empty: no ids, and the digests of nothing. A text may be as long as a cell can be. Repeated
    rows are encoded each for itself; null ids of documents pass through; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    path, pattern = path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or gpt_pattern()
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        coder = TextCoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back = [], [], []
            for flat, starts in coder.ids(batch.column("text")):
                n += np.diff(starts).tolist()
                for written, decoded in coder.written(flat, starts):
                    ids.append(hashlib.sha256(written).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
            return batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids, pa.string()), decoded_sha256=pa.array(back, pa.string()))

        return work

    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return map_whole_batches(plain, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
