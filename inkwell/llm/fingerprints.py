"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (its lines). Every paragraph is hashed to a wide vector: LANES counters,
one for each bit of the 64-bit hashes of its word triples (plus one where the bit is set, minus one where it is
not), and four 64-bit numbers from a cryptographic digest of the paragraph. A document's fingerprint is the sum of
its paragraphs' vectors, counters modulo 2^32, which no text that fits a cell goes round, numbers modulo 2^64. So it does not depend on the order of the
paragraphs, and inserting or deleting one adds or subtracts its vector. The numbers settle equality; the counters
are a sketch whose inner products estimate how much two texts share.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SLICE_ROWS, bound_batches
from inkwell.scratch import materialize

LANES = 64
#: Bytes of the input, as Spark estimates them, that make a range, and the most ranges, beyond the session's own number.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000


def paragraph_vector(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    """(LANES counters as int64, four uint64) of one paragraph."""
    data = paragraph.encode()
    words = data.split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    digest = np.frombuffer(hashlib.blake2b(data, digest_size=32).digest(), "<u8")
    if not grams:
        return np.zeros(LANES, np.int64), digest
    hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], "<u8")
    counters = np.zeros(LANES, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        counters += 2 * np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) - len(part)
    return counters, digest


class Fingerprint:
    """Sum of paragraph vectors; `add` takes how often to insert, below zero to delete."""

    def __init__(self, counters: np.ndarray | None = None, numbers: np.ndarray | None = None):
        self.counters = np.zeros(LANES, np.int64) if counters is None else counters
        self.numbers = np.zeros(4, np.uint64) if numbers is None else numbers

    def copy(self) -> Fingerprint:
        return Fingerprint(self.counters.copy(), self.numbers.copy())

    def add(self, vector: tuple[np.ndarray, np.ndarray], times: int = 1) -> Fingerprint:
        self.counters += times * vector[0]
        self.numbers = self.numbers + vector[1] * np.uint64(times % (1 << 64))
        return self

    def hex(self) -> str:
        return (self.counters & 0xFFFFFFFF).astype(">u4").tobytes().hex() + self.numbers.astype(">u8").tobytes().hex()


def of_text(text: str) -> Fingerprint:
    out = Fingerprint()
    for p in text.split("\n"):
        out.add(paragraph_vector(p))
    return out


def edited_fingerprint(old: Fingerprint, before: str, after: str) -> Fingerprint:
    """The fingerprint of `after` from that of `before`: delete the paragraphs that go, insert those that come."""
    change: dict[str, int] = defaultdict(int)
    for p in before.split("\n"):
        change[p] -= 1
    for p in after.split("\n"):
        change[p] += 1
    out = old.copy()
    for p, n in change.items():
        if n:
            out.add(paragraph_vector(p), n)
    return out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: 1 for equal fingerprints, about the share of word triples in common otherwise."""
    if np.array_equal(a.numbers, b.numbers):
        return 1.0
    x, y = a.counters.astype(float), b.counters.astype(float)
    norm = float(x @ x + y @ y)
    return round(min(1.0, max(0.0, 2 * float(x @ y) / norm)), 6) if norm else 0.0


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, own: Fingerprint, follower: str, next_print: Fingerprint) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + follower[:cut]
    changed = edited_fingerprint(own, text, edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, next_print)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by the first as many of the
    next document in ascending doc_id; after the last document comes the first. Rows are dealt in ranges of doc_id
    and sorted there, each text moving once; what the last row of a range needs from the next range is patched in
    from the ranges' first and last rows, which are few. Null texts count as empty; texts may be as long as a cell
    can be; null ids come first; rows with equal ids follow each other by their texts' xxhash64, and equal rows by a
    number of their own, so that they too are spread over ranges. Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = int(str(plain._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, MOST_RANGES))
    order = ["doc_id", "hash", "number"]
    keyed = plain.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").withColumn("part", F.spark_partition_id())
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def sweep(batches):
        """Finished rows; the first row again with edge 1, and the last with edge 2 and nothing computed, for the patch."""
        last = None
        for big in batches:
            for at in range(0, big.num_rows, SLICE_ROWS):
                batch = big.slice(at, SLICE_ROWS)
                ids, part, rows = [], batch.column("part")[0].as_py(), []
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                    own = of_text(text)
                    if last is None:
                        ids.append(doc_id)
                        rows.append((part, 1, text, *[None] * 6))
                    else:
                        ids.append(last[0])
                        rows.append((part, 0, None, *_compare(last[1], last[2], text, own)))
                    last = doc_id, text, own
                yield _table(ids, rows, batch.column("doc_id").type, kinds, names)
        if last is not None:
            yield _table([last[0]], [(part, 2, last[1], *[None] * 6)], last[0].type, kinds, names)

    swept = materialize(ranged.mapInArrow(sweep, f"doc_id {kind}, part int, edge int, text string, {OUT}"), "fingerprints")
    done = swept.filter("edge = 0").select("doc_id", *names)
    #: one number for each range that has rows
    filled = sorted(r["part"] for r in swept.filter("edge = 1").select("part").collect())
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, next_part int")
    lasts = swept.filter("edge = 2").select("doc_id", "text", "part").join(F.broadcast(follows), "part")
    firsts = swept.filter("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("follower"))

    def patch(batches):
        for batch in batches:
            rows = []
            for text, follower in zip(batch.column("text").to_pylist(), batch.column("follower").to_pylist(), strict=True):
                rows.append(_compare(text, of_text(text), follower, of_text(follower)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", *names])

    edges = lasts.join(firsts, "next_part").select("doc_id", "text", "follower").mapInArrow(patch, f"doc_id {kind}, {OUT}")
    return done.unionByName(edges)


def _table(ids: list, rows: list[tuple], id_type: pa.DataType, kinds: list, names: list[str]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), *kinds]
    return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], id_type), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["doc_id", "part", "edge", "text", *names])
