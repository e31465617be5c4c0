"""Near-duplicates by SimHash fingerprints, compared exactly tile by tile.

Each text has a 64-bit fingerprint: bit by bit the majority over the hashes of its word shingles. Texts whose
fingerprints differ in at most `radius` bits are linked. Equal fingerprints are one class; the classes'
fingerprints, sorted by population counts, are laid out in blocks of BLOCK and tiles of TILE. A pair of tiles is
compared with exclusive-or and bit counts on whole arrays, unless population counts rule it out: those of the whole
word, of its halves, its quarters and its bytes each give a lower bound on the distance of any two members, and a
pair of tiles (or of blocks) whose bound exceeds the radius is skipped. So no link is lost, and no pair is sent
anywhere: blocks are dealt in panels, a task gets two panels (or one), each block once, compares their blocks and
returns a spanning forest of the links it found, at most one row for each fingerprint, from which components are made
by distributed star rounds.

Comparisons grow with the square of the distinct fingerprints that the bounds leave. What is sent grows with the
fingerprints times the number of panels, and there are n / (BLOCK PANEL) of these once each holds PANEL blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch_of, map_batches, texts
from inkwell.llm.components import components
from inkwell.scratch import materialize

BLOCK, TILE = 16384, 256
#: Blocks of a panel at most, and panels that are made at least if there are blocks for them.
PANEL, PANELS = 16, 12
_SLAB = 8192


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, unsigned: A-Z lowered, words between ASCII spaces, shingles of `width` words."""
    return majority(shingle_hashes(text, width, seed))


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle in turn, repeats included; a text of fewer words is one shingle, of none has none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    data = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where they are in over half of the hashes; zero for none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLAB):
        ones += np.unpackbits(hashes[at : at + _SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def population(fps: np.ndarray) -> np.ndarray:
    """Set bits of each byte, quarter, half and of the whole, one row for each fingerprint: 8 + 4 + 2 + 1 columns."""
    bytes_ = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = bytes_[:, 0::2] + bytes_[:, 1::2]
    halves = quarters[:, 0::2] + quarters[:, 1::2]
    return np.hstack([bytes_, quarters, halves, halves.sum(1, keepdims=True, dtype=np.int16)])


_LEVELS = ((0, 8), (8, 12), (12, 14), (14, 15))


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Lower bounds, for all pairs, on the distance between members of sets with these ranges of population counts."""
    gap = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]))
    return np.max([gap[..., a:b].sum(-1) for a, b in _LEVELS], axis=0)


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, at = population(fps), np.arange(0, len(fps), TILE)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`labels` (each the least member known of its set) after the links i-j."""
    while len(i):
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two arrays of fingerprints, or within one: (member, root)."""
    both = a if b is None else np.concatenate([a, b])
    shift, other = (0, a) if b is None else (len(a), b)
    labels = np.arange(len(both))
    skip = apart(*_tiles(a), *_tiles(other)) > radius
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for x in range(skip.shape[0]):
        own = a[x * TILE : (x + 1) * TILE, None]
        for y in np.flatnonzero(~skip[x]):
            if b is None and y < x:
                continue
            i, j = np.nonzero(np.bitwise_count(own ^ other[None, y * TILE : (y + 1) * TILE]) <= radius)
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append((i + x * TILE, j + y * TILE + shift))
                held += len(i)
                if held > 1_000_000:
                    labels, found, held = _join(labels, *map(np.concatenate, zip(*found, strict=True))), [], 0
    if found:
        labels = _join(labels, *map(np.concatenate, zip(*found, strict=True)))
    member = np.flatnonzero(labels != np.arange(len(both)))
    return both[member], both[labels[member]]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in texts(batch)], "<u8").view("<i8")
        return batch_of(doc_id=batch.column("doc_id"), fp=pa.array(fps))

    return map_batches(docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text"), lambda: work, f"doc_id {kind}, fp long")


def links(classes: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(u, v): a spanning forest, block pair by block pair, of the links between the n distinct `fp` of classes."""
    spark = classes.sparkSession
    keys = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))).alias(f"q{s}") for s in (0, 16, 32, 48)]
    ordered = ["q0", "q16", "q32", "q48", "fp"]

    def lay_out(batches):
        parts = [b.column("fp").to_numpy() for b in batches if b.num_rows]
        if not parts:
            return
        fps, number = np.concatenate(parts), None
        for at in range(0, len(fps), 2 * BLOCK):
            block = fps[at : at + 2 * BLOCK].view("<u8")
            counts = population(block)
            number = int(block[0].view("<i8"))  # unique, as fingerprints are distinct
            yield batch_of(block=pa.array([number]), fps=pa.array([block.tobytes()], pa.binary()), low=pa.array([counts.min(0).tobytes()], pa.binary()), high=pa.array([counts.max(0).tobytes()], pa.binary()))

    blocks = materialize(
        classes.select("fp", *keys).repartitionByRange(max(1, -(-n // BLOCK)), *ordered).sortWithinPartitions(*ordered).select("fp").mapInArrow(lay_out, "block long, fps binary, low binary, high binary"),
        "blocks",
    )
    #: 68 bytes for each block of BLOCK fingerprints
    ranges = sorted((r["block"], r["low"], r["high"]) for r in blocks.select("block", "low", "high").collect())
    read = lambda at: np.array([np.frombuffer(r[at], np.int16) for r in ranges]).reshape(-1, 15)
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in ranges]), read(1), read(2)))

    size = max(1, min(PANEL, len(ranges) // PANELS))
    panels = -(-len(ranges) // size)

    def deal(batches):
        """Each block once for every pair of panels that it may have links in; `at` is its place in the order."""
        numbers, low, high = shared.value
        for batch in batches:
            for block, fps in zip(batch.column("block").to_pylist(), batch.column("fps").to_pylist(), strict=True):
                at = int(np.searchsorted(numbers, block))
                near = np.flatnonzero(apart(low[at : at + 1], high[at : at + 1], low, high)[0] <= radius)
                for p in np.unique(near // size).tolist():
                    own = at // size
                    yield batch_of(a=pa.array([min(own, p)]), b=pa.array([max(own, p)]), at=pa.array([at]), fps=pa.array([fps], pa.binary()))

    def compare(table: pa.Table) -> pa.Table:
        numbers, low, high = shared.value
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        sides = dict(sorted((o, np.frombuffer(f, "<u8")) for o, f in zip(table.column("at").to_pylist(), table.column("fps").to_pylist(), strict=True)))
        found = [(np.zeros(0, "<u8"), np.zeros(0, "<u8"))]
        for x in sides:
            # Pairs within one panel belong to that panel's own task.
            own = [y for y in sides if (y >= x if a == b else x // size == a and y // size == b)]
            for y in (own[k] for k in np.flatnonzero(apart(low[x : x + 1], high[x : x + 1], low[own], high[own])[0] <= radius)) if own else ():
                found.append(linked(sides[x], None if x == y else sides[y], radius))
        u, v = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"u": u.view("<i8"), "v": v.view("<i8")})

    dealt = blocks.select("block", "fps").mapInArrow(deal, "a long, b long, at long, fps binary")
    #: no more partitions than there are pairs of panels
    return dealt.repartition(max(1, panels * (panels + 1) // 2), "a", "b").groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, for every row.

    Null and empty texts have the fingerprint zero, which is linked like any other. Equal texts, repeated rows and
    equal fingerprints are one class. Null ids never become a component's id unless it has no other. An empty table
    gives an empty result.
    """
    prints = materialize(fingerprints(docs, width, seed, id_col, text_col), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    n = classes.count()
    roots = components(links(classes, n, radius)).withColumnsRenamed({"u": "fp", "v": "root"})
    rooted = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
