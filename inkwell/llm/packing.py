"""Packing documents into sequences of a fixed number of tokens, with as few sequences as it can.

Lengths are whole numbers up to the sequence length, so a plan needs only how many pieces have each length: it is
made on the driver from at most `capacity` counts, however large the corpus is. The plan follows the linear grouping
scheme: lengths over a share of the capacity are put in groups of equal cardinality and rounded up to the longest of
their group; configurations of these few sizes are optimised (the fullest choice of sizes beside the largest one
left, used as often as the counts allow); the actual documents take the places, which frees what the rounding took;
small documents then go, largest first, where they fit best. Some numbers of groups and some shares are tried, and the
plan with the fewest sequences is used. Bins of one kind are planned together, as (count, lengths).

The pieces of each length are numbered without gaps by (length, salt), so that no length gathers in one task, and
find their place in the plan by that number.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.bpe import vocabulary_path
from inkwell.llm.common import batch_of, map_batches, map_whole_batches, salt
from inkwell.llm.pieces import UnitStream
from inkwell.scratch import materialize

#: Numbers of groups, and shares of the capacity above which a length is large.
GROUPS, LARGE_SHARES = (128, 256, 384), (1 / 2, 1 / 3, 1 / 4)
#: Units that the tokenizer gets as one string.
JOINED = 1000

Bins = list[tuple[int, tuple[int, ...]]]


def _linear_groups(counts: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """Rounded size -> runs [length, count] of the actual lengths, longest first; groups of equal cardinality.

    A length may fall into two groups; groups that round up to the same size are one.
    """
    each = max(1, -(-sum(counts.values()) // groups))
    out: dict[int, list[list[int]]] = {}
    top, room = 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                top, room = length, each
            take = min(left, room)
            out.setdefault(top, []).append([length, take])
            left, room = left - take, room - take
    return out


def _fullest(room: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """Sizes whose sum comes closest to `room` from below, fewest pieces first among equals; counts are respected."""
    mask = (1 << room + 1) - 1
    usable = [s for s in sizes if s <= room and left[s]]
    reach, layers = 1, []
    while usable and (not layers or len(layers) < room // usable[-1]):
        new = 0
        for s in usable:
            new |= reach << s
        new &= mask
        if not new:
            break
        layers.append(new)
        reach = new
        if new >> room & 1:
            break
    best = max((layer.bit_length() - 1 for layer in layers), default=0)
    depth = next((k for k, layer in enumerate(layers) if layer >> best & 1), -1)
    chosen: list[int] = []
    need, used = best, defaultdict(int)
    for k in range(depth, -1, -1):
        below = layers[k - 1] if k else 1
        s = next((s for s in usable if s <= need and below >> (need - s) & 1 and used[s] < left[s]), None)
        if s is None:
            break
        chosen.append(s)
        used[s] += 1
        need -= s
    return chosen


def _configurations(demand: dict[int, int], capacity: int) -> Bins:
    """Configurations of few sizes: beside the largest size left, the fullest choice of others."""
    left, sizes, out = dict(demand), sorted(demand, reverse=True), []
    for size in sizes:
        while left[size]:
            left[size] -= 1
            config = [size, *_fullest(capacity - size, sizes, left)]
            left[size] += 1
            times = min(left[s] // config.count(s) for s in set(config))
            for s in config:
                left[s] -= times
            out.append((times, tuple(config)))
    return out


def _substitute(configs: Bins, groups: dict[int, list[list[int]]]) -> Bins:
    """The same bins with actual lengths in place of the rounded ones."""
    out: Bins = []
    for times, config in configs:
        while times:
            heads = []
            take = times
            need: dict[int, int] = defaultdict(int)
            for size in config:
                need[size] += 1
            for size, n in need.items():
                run = groups[size][0]
                take = min(take, run[1] // n) if run[1] >= n else 0
            if take:
                for size in config:
                    heads.append(groups[size][0][0])
                    groups[size][0][1] -= take
            else:  # a run too short to serve every place of its size: one bin from several runs
                take = 1
                for size in config:
                    heads.append(groups[size][0][0])
                    groups[size][0][1] -= 1
                    if not groups[size][0][1]:
                        groups[size].pop(0)
            for size in need:
                if groups[size] and not groups[size][0][1]:
                    groups[size].pop(0)
            out.append((take, tuple(heads)))
            times -= take
    return out


def best_fit(bins: Bins, counts: dict[int, int], capacity: int) -> Bins:
    """Add pieces, longest first, each where the least room is left that takes it; open bins for the rest."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for times, lengths in bins:
        by_room[capacity - sum(lengths)].append((times, lengths))
    rooms = sorted(by_room)

    def put(room: int, times: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room:
            insort(rooms, room)
        by_room[room].append((times, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, -(-left // (capacity // length)), ())
                continue
            room = rooms[at]
            times, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            many = min(room // length, left)
            use = min(times, left // many)
            if times > use:
                put(room, times - use, lengths)
            put(room - many * length, use, lengths + (length,) * many)
            left -= use * many
    return [(times, lengths) for runs in by_room.values() for times, lengths in runs if lengths]


def plan_sequences(counts: dict[int, int], capacity: int, shares: tuple[float, ...] = LARGE_SHARES, tried: tuple[int, ...] = GROUPS) -> Bins:
    """The bins for `counts` (length -> number of pieces), as (number of such bins, their lengths)."""
    full = counts.get(capacity, 0)
    counts = {n: c for n, c in counts.items() if c and n < capacity}
    best: Bins | None = None
    for share in shares:
        large = {n: c for n, c in counts.items() if n > share * capacity}
        small = {n: c for n, c in counts.items() if n not in large}
        for groups in tried:
            rounded = _linear_groups(large, groups)
            configs = _configurations({s: sum(c for _, c in runs) for s, runs in rounded.items()}, capacity)
            bins = best_fit(_substitute(configs, rounded), small, capacity)
            if best is None or sum(c for c, _ in bins) < sum(c for c, _ in best):
                best = bins
    return ([(full, (capacity,))] if full else []) + (best or [])


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def unit_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes units (see pieces) to ids as little-endian unsigned 32-bit numbers.

    Units that begin with a space and something else than white space are encoded by themselves also when they stand
    in a row, so the tokenizer gets them JOINED at a time; the bytes that its tokens stand for tell where each one ends.
    """
    tokenizer = _tokenizer(path)
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    #: a byte-level token has one character for each byte
    width = np.array([len(tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())])

    def ids(strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in encode(strings, add_special_tokens=False)]

    def work(units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        joined = [k for k, u in enumerate(units) if u[:1] == " " and len(u) > 1 and not u[1].isspace()]
        if len(joined) < len(units):
            alone = sorted(set(range(len(units))).difference(joined))
            for k, own in zip(alone, ids([units[k] for k in alone]), strict=True):
                out[k] = own.tobytes()
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            strings = [units[k] for k in some]
            (row,) = ids(["".join(strings)])
            ends = np.searchsorted(np.cumsum(width[row]), np.cumsum([len(s.encode()) for s in strings])) + 1
            data, start = row.tobytes(), 0
            for k, end in zip(some, (4 * ends).tolist(), strict=True):
                out[k], start = data[start:end], end
        return out

    return work


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end_id`, cut where longer than `capacity`.

    Pieces are full from the end; the first one may be shorter. A null text counts as empty: one piece with the
    end id. A text may be as long as a cell can be. Repeated rows are packed each for itself; other columns, whatever
    their names, are not read; an empty table gives an empty result.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    kind, tail = docs.schema[id_col].dataType.simpleString(), np.array([end_id], "<u4").tobytes()

    def make():
        stream = UnitStream(unit_encoder(path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, k = [], [], [], [], [], 0
            for flat, bounds in stream.values(batch.column("text")):
                data, bounds = memoryview(flat.tobytes()), (4 * bounds).tolist()
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    n = (end - begin) // 4 + 1
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        held = zlib.crc32(data[begin + 4 * a : min(end, begin + 4 * b)])
                        crc.append(zlib.crc32(tail, held) if b == n else held)
                    k += 1
            return batch_of(doc_id=batch.column("doc_id").take(pa.array(row, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

        return work

    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return map_whole_batches(plain, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ..., any columns but those named here)."""
    spark = pieces.sparkSession
    parts = max(8, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    #: pieces have a row number of their own, so rows that are repeated spread like any others
    pieces = pieces.withColumn("_salt", salt(F.col("_row"), parts=parts))
    #: at most capacity x parts rows, whatever the corpus
    counted = sorted((r["length"], r["_salt"], r["count"]) for r in pieces.groupBy("length", "_salt").count().collect())
    totals: dict[int, int] = defaultdict(int)
    first: dict[int, int] = {}
    for length, s, n in counted:
        first[length * parts + s] = totals[length]
        totals[length] += n
    rows, taken, sequence = [], defaultdict(int), 0
    for times, lengths in plan_sequences(dict(totals), capacity):
        at = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, at))
            taken[length] += times
            at += length
        sequence += times
    rows.sort()
    plan = np.array(rows, np.int64).reshape(-1, 4)
    span = max(totals.values(), default=0) + 1
    shared = spark.sparkContext.broadcast((np.array(list(first)), np.array(list(first.values())), plan[:, 0] * span + plan[:, 1], plan))

    def make():
        keys, firsts, starts, plan = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column("length").to_numpy()
            rank = firsts[np.searchsorted(keys, length * parts + batch.column("_salt").to_numpy())] + batch.column("_rank").to_numpy() - 1
            found = plan[np.searchsorted(starts, length * span + rank, side="right") - 1]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("_salt", "_rank", "_row")}
            return batch_of(**columns, sequence_id=pa.array(found[:, 2] + rank - found[:, 1]), offset=pa.array(found[:, 3]))

        return work

    order = Window.partitionBy("length", "_salt").orderBy("_row")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("_salt", "_row"))
    return map_batches(pieces.withColumn("_rank", F.row_number().over(order).cast("long")), make, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place. Empty tables give none."""
    return place_pieces(token_pieces(docs, capacity, end_id, id_col, text_col, path), capacity)
