"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form an indivisible group. Groups, largest first, enter the bin with the tightest room
that still takes them, found in a balanced tree of the bins' rooms; the capacity is the smallest at which the bins
asked for suffice, so their sizes are nearly equal.

Groups of one size are interchangeable, so the packing needs only how many groups have each size: the driver holds one
count for each of at most some ninety thousand size classes, however many groups there are. Sizes below EXACT are
classes of their own; larger ones are rounded up to ten binary digits, which is less than a thousandth. Equal groups
enter the tightest bin until it takes no more, which is what best-fit decreasing does with them one by one. Groups
then find their bin by their number within their class; these numbers are given in salted parts, so that no class
gathers in one task.

A group that is larger than a bin cannot be kept whole with bins of near equal size; it alone is divided, by a number
that each row has, into parts of about a 16th of a bin.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import batch_of, map_batches, salt
from inkwell.scratch import materialize

#: Sizes from which classes are rounded, and the binary digits that they keep.
EXACT, DIGITS = 1 << 16, 10
HOT_PARTS = 16
#: Groups of a class, or rows of a shard, that one task numbers, about.
NUMBERED = 100_000


class Treap:
    """A balanced search tree of (room, bin); priorities come from a seeded generator."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.random = random.Random(7).random

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random(), None, None]), high)

    def pop_at_least(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Take out the smallest entry that is not below `key`."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


Runs = list[tuple[int, int, int]]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> Runs:
    """(size, bin, items) in the order in which the items of (size, number of items) enter bins, sizes descending.

    An item over the capacity has a bin of its own.
    """
    rooms, bins, out = Treap(), 0, []
    for size, count in classes:
        while count:
            found = rooms.pop_at_least((size, -1))
            room, at = found or (max(capacity, size), bins)
            bins += found is None
            take = min(count, room // size)
            out.append((size, at, take))
            rooms.insert((room - take * size, at))
            count -= take
    return out


def pack_into(classes: list[tuple[int, int]], n_bins: int) -> Runs:
    """Best-fit decreasing at the smallest capacity, to one part in 4096, that needs no more than n_bins."""
    mean = -(-sum(s * c for s, c in classes) // n_bins)
    needed = lambda runs: max((at for _, at, _ in runs), default=-1) + 1
    low = max(mean, max((s for s, _ in classes), default=0))
    best, high, span = best_fit_decreasing(classes, low), low, max(1, low // 4096)
    while needed(best) > n_bins:
        low, high, span = high, high + span, 2 * span
        best = best_fit_decreasing(classes, high)
    while high - low > max(1, high // 4096):
        mid = (low + high) // 2
        tried = best_fit_decreasing(classes, mid)
        if needed(tried) <= n_bins:
            best, high = tried, mid
        else:
            low = mid
    return best


def size_class(size: str) -> Column:
    """The size itself below EXACT, else the size rounded up to DIGITS binary digits."""
    # The digits of a positive long, less those kept, are dropped and 1 is added if any of them was set.
    drop = f"(length(bin({size})) - {DIGITS})"
    return F.expr(f"CASE WHEN {size} < {EXACT} THEN {size} ELSE shiftleft(shiftright({size} - 1, {drop}) + 1, {drop}) END")


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the law `bytes` holds (shards of near equal size).

    A row's size is its text's UTF-8 bytes plus 16; texts may be as long as a cell can be. Null texts form a group
    apart from empty ones and have no bytes (crc 0). Repeated rows belong to their text's group and keep their own
    slots; ties are settled by the rows' numbers. Slots of a shard count from 0 without gaps. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    body = F.col(f"`{text_col}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"\x00")).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = materialize(narrow, "shards")
    spark = docs.sparkSession
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    mean = max(1, -(-total // n_shards))
    groups = narrow.groupBy("group").agg(F.sum("size").alias("bytes"))
    #: fewer than n_shards rows, as each has more than a shard's share
    hot = groups.filter(F.col("bytes") > mean).select("group", F.ceil(F.col("bytes") * HOT_PARTS / mean).cast("int").alias("parts")).collect()
    hot_df = F.broadcast(spark.createDataFrame(hot, "group binary, parts int"))
    rows = narrow.join(hot_df, "group", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    units = rows.groupBy("group", "part").agg(F.sum("size").alias("bytes"))
    units = materialize(units.withColumn("class", size_class("bytes")).withColumn("unit", F.monotonically_increasing_id()), "units")
    #: one row for each size class
    counts = sorted(((r["class"], r["count"]) for r in units.groupBy("class").count().collect()), reverse=True)
    placed = _place(units, pack_into(counts, n_shards), dict(counts))
    shards = rows.join(placed, ["group", "part"]).select("doc_id", "size", "text_crc32", "row", "shard")
    out = with_slots(materialize(shards, "placed"), max(64, -(-n // (n_shards * NUMBERED))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _place(units: DataFrame, runs: Runs, counts: dict[int, int]) -> DataFrame:
    """group, part and shard of units (group, part, class, unit), by their numbers within their class."""
    spark = units.sparkSession
    #: classes with more units than one task should number; at most one row for each NUMBERED units
    many = spark.createDataFrame([(c, 1 + n // NUMBERED) for c, n in counts.items() if n > NUMBERED], "class long, parts int")
    salted = units.join(F.broadcast(many), "class", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("unit"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    #: one row for each salted part of the classes that have several
    listed = salted.join(F.broadcast(many), "class", "left_semi").groupBy("class", "salt").count().collect()
    offsets, seen = [], dict.fromkeys(counts, 0)
    for c, s, k in sorted(listed):
        offsets.append((c, s, seen[c]))
        seen[c] += k
    first = F.broadcast(spark.createDataFrame(offsets, "class long, salt int, before long"))
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("unit"))
    ranked = salted.withColumn("rank", rank.cast("long") - 1).join(first, ["class", "salt"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))

    # Runs in the order of (class, first number): a few for each class.
    taken, table = dict.fromkeys(counts, 0), []
    for size, at, k in runs:
        table.append((size, taken[size], at))
        taken[size] += k
    held = np.array(sorted(table), np.int64).reshape(-1, 3)
    sizes, begins = np.unique(held[:, 0], return_index=True)
    shared = spark.sparkContext.broadcast((sizes, np.append(begins, len(held)), held[:, 1].copy(), held[:, 2].astype(np.int32)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, begins, starts, bins = shared.value
        at = np.searchsorted(sizes, batch.column("class").to_numpy())
        low, high, rank = begins[at].copy(), begins[at + 1].copy(), batch.column("rank").to_numpy()
        while (open_ := high - low > 1).any():  # the last run of the class that begins at the rank or before
            mid = (low + high) // 2
            up = open_ & (starts[np.minimum(mid, len(starts) - 1)] <= rank)
            low, high = np.where(up, mid, low), np.where(open_ & ~up, mid, high)
        return batch_of(group=batch.column("group"), part=batch.column("part"), shard=pa.array(bins[low]))

    return map_batches(ranked.select("group", "part", "class", "rank"), lambda: work, "group binary, part int, shard int")


def with_slots(placed: DataFrame, parts: int = 64) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in `parts` parts salted by row so that no task holds a shard."""
    spark = placed.sparkSession
    placed = placed.withColumn("_salt", salt(F.col("row"), parts=parts))
    #: at most parts rows for each shard, and one for each NUMBERED rows of the table
    counted = sorted((r["shard"], r["_salt"], r["count"]) for r in placed.groupBy("shard", "_salt").count().collect())
    offsets, seen = [], {}
    for shard, s, n in counted:
        offsets.append((shard, s, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    first = F.broadcast(spark.createDataFrame(offsets, "shard int, _salt int, _first long"))
    rank = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy("doc_id", "row"))
    return placed.withColumn("_rank", rank).join(first, ["shard", "_salt"]).withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_salt", "_first", "_rank")
