"""Near-duplicates by SimHash links that an exact Jaccard check confirms, and no link lost.

Texts whose sets of shingles overlap in four fifths of their union or more are linked. Equal sets are one class. The
classes' fingerprints (simhash.py, over the same shingles) are compared tile by tile; what differs in at most `radius`
bits is a candidate, and so is a class with one or two others that share many keys (below). Candidates are compared
exactly, on the whole sets (64-bit hashes stand for shingles), and components are made of those that are similar.

No radius covers a similarity of four fifths for certain, so the rest is found by prefixes: with every set in one
order, two such sets share a member among the first n - ceil(4 n / 5) + 1 of each. Any order is right; hashes are
used, with shingles that are common in a sample last, so that few texts meet in one of those. Pairs in different
components that share such a key, and share as many as the similarity demands, are compared exactly as well. Members
of one component need no pairs among themselves, which keeps large groups of copies cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch_of, map_batches, texts
from inkwell.llm.components import components
from inkwell.llm.simhash import links, majority, shingle_hashes
from inkwell.scratch import Scope, materialize

WIDTH, SEED = 5, 42
#: Bits in which fingerprints of candidates may differ: beyond, chance pairs of a large corpus outnumber the similar.
RADIUS = 7
#: Documents of the sample that tells common shingles, documents of it that a common one is in, and the most listed.
SAMPLE, COMMON, LISTED = 20_000, 4, 100_000
_LOWEST = np.int64(-(1 << 63))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct 63-bit hashes, ascending: A-Z lowered, words between ASCII spaces, shingles of `width` words."""
    return _distinct(shingle_hashes(text, width, SEED))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(1)).view("<i8"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    n = len(a) + len(b)
    return 9 * min(len(a), len(b)) >= 4 * n and 9 * (n - len(np.union1d(a, b))) >= 4 * n


def _digest(held: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(held.tobytes())).view(np.int64))


def _prefix(held: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first keys of a set: hashes below zero, or the hashes themselves (and so after those) if they are common."""
    keys = held + _LOWEST
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        keys[common[at] == held] -= _LOWEST
    return np.sort(keys)[: len(held) - (4 * len(held) + 4) // 5 + 1]


def _common(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that are in COMMON sampled documents or more, at most LISTED of them, ascending."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(h=pa.array(np.concatenate([np.zeros(0, np.int64), *(shingles(t) for t in texts(batch))])))

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    counted = map_batches(sampled, lambda: work, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    rows = counted.orderBy(F.col("count").desc(), "h").limit(LISTED).select("h").collect()  # LISTED longs
    return np.sort(np.array([r["h"] for r in rows], np.int64))


def _prints(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, row (hash of the text), digest (of the set), n (its members), keys (its prefix), fp for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, docs.count()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, WIDTH, SEED) for t in texts(batch)]
        fps = np.array([majority(h) if len(h) > 1 else int(h.sum()) for h in hashes], "<u8").view("<i8")
        sets = [_distinct(h) for h in hashes]
        keys = [_prefix(s, shared.value) for s in sets]
        offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        return batch_of(
            doc_id=batch.column("doc_id"), row=batch.column("row"), digest=pa.array([_digest(s) for s in sets], pa.int64()), n=pa.array([len(s) for s in sets], pa.int32()),
            keys=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))), fp=pa.array(fps),
        )

    plain = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return map_batches(plain, lambda: work, f"doc_id {kind}, row long, digest long, n int, keys array<long>, fp long")


def _alike(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v): digests of classes whose fingerprints are equal or linked, by way of the least digest of each fingerprint."""
    named = materialize(classes.groupBy("fp").agg(F.min("digest").alias("least")), "named")
    found = links(named.select("fp"), named.count(), radius)
    side = lambda name: named.select(F.col("fp").alias(name), F.col("least").alias(f"of_{name}"))
    near = found.join(side("u"), "u").join(side("v"), "v").select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v"))
    same = classes.join(named, "fp").filter("digest > least").select(F.col("least").alias("u"), F.col("digest").alias("v"))
    return near.union(same)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): those of the pairs of digests whose sets, made anew from the texts, are similar."""
    with Scope() as scope:
        return scope.keep(_compared(materialize(pairs, "pairs"), docs, classes))


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("u").alias("digest")).union(pairs.select(F.col("v").alias("digest"))).distinct()
    named = classes.join(wanted, "digest", "left_semi").select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row")).distinct()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts(batch)]
        return batch_of(digest=pa.array([_digest(s) for s in sets], pa.int64()), held=pa.array([s.tobytes() for s in sets], pa.binary()))

    found = docs.select("doc_id", "text").join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left_semi")
    sets = materialize(map_batches(found, lambda: work, "digest long, held binary"), "sets").dropDuplicates(["digest"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda name: (np.frombuffer(x, "<i8") for x in batch.column(name).to_pylist())
        good = pa.array([similar(a, b) for a, b in zip(read("a"), read("b"), strict=True)], pa.bool_())
        return batch.select(["u", "v"]).filter(good)

    sides = pairs.join(sets.select(F.col("digest").alias("v"), F.col("held").alias("b")), "v").join(sets.select(F.col("digest").alias("u"), F.col("held").alias("a")), "u")
    return materialize(map_batches(sides.select("u", "v", "a", "b"), lambda: compare, "u long, v long"), "similar")


#: Pairs that are handed on together, about, and members of a group from which their keys are compared in the group.
HANDED, MANY = 50_000, 32


def _across(batches, many):
    """(u, v, c, need) for pairs of a group's members in different components: `need` shared keys, or more, if similar.

    `met` is how many keys of a member any other class has; pairs that cannot share as many as they need are not made.
    A small group gives its pairs with c = 1 for its own key. Members of a large group bring their keys of large groups:
    those that two of them share are counted here, and a pair is given once, by the group of the first of them, if they
    and what other keys the two may share suffice. So a large group gives few pairs that are not to be compared, and
    holds no more than its members' keys.
    """
    held, n_held = [], 0

    def ready():
        return batch_of(**{name: pa.array(np.concatenate(c)) for name, c in zip(("u", "v", "c", "need"), zip(*held, strict=True), strict=True)})

    for big in batches:
        lists, own_keys = big.column("members"), big.column("key").to_numpy()
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        columns = [flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("digest", "n", "last", "comp", "met")]
        listed, first = flat.field("keys"), ends[0]
        for key, start, end in zip(own_keys.tolist(), (ends - first).tolist(), (ends[1:] - first).tolist(), strict=False):
            order = start + np.argsort(columns[0][start:end])
            digest, n, last, comp, met = (c[order] for c in columns)
            beyond = (4 * n + 4) // 5 - 1  # members after the prefix
            large = end - start > many
            if large:
                keys = [listed[k].values.to_numpy() for k in order.tolist()]
                member = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                every = np.concatenate(keys)
                other = met - np.array([len(k) for k in keys])
                by_key = np.argsort(every, kind="stable")
                every, member = every[by_key], member[by_key]
            for i in range(len(digest) - 1):
                j = np.arange(i + 1, len(digest))
                j = j[(comp[j] != comp[i]) & (9 * np.minimum(n[j], n[i]) >= 4 * (n[j] + n[i]))]
                need = -(-4 * (n[j] + n[i]) // 9) - np.where(last[i] <= last[j], beyond[i], beyond[j])
                able = need <= np.minimum(met[j], met[i])
                j, need, c = j[able], need[able], np.ones(int(able.sum()), np.int64)
                if large and len(j):
                    low, high = np.searchsorted(every, keys[i]), np.searchsorted(every, keys[i], side="right")
                    runs = [member[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    earlier = int(np.searchsorted(keys[i], key))
                    before = np.bincount(np.concatenate([member[:0], *runs[:earlier]]), minlength=len(digest))[j]
                    c = np.bincount(np.concatenate(runs), minlength=len(digest))[j]
                    enough = (before == 0) & (c + np.minimum(other[j], other[i]) >= need)
                    j, need, c = j[enough], need[enough], c[enough]
                if len(j):
                    held.append((np.full(len(j), digest[i]), digest[j], c, need))
                    n_held += len(j)
                    if n_held > HANDED:
                        yield ready()
                        held, n_held = [], 0
    if held:
        yield ready()


def near_texts(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, row, component_id and kept for every row of docs (doc_id, text, and any other columns).

    `row` is Spark's xxhash64 of the text; component_id the smallest doc_id reachable over links; `kept` tells the rows
    with the smallest (doc_id, row) of their component, so one id and text for each. Null and empty texts are linked to
    each other and to nothing else; texts of fewer than WIDTH words are one shingle. Null ids come after all others.
    Texts may be as long as a cell can be; rows that are repeated are one class. An empty table gives an empty result.
    """
    prints = materialize(_prints(docs, docs.schema["doc_id"].dataType.simpleString()), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = materialize(prints.groupBy("digest").agg(F.min(place).alias("first"), F.min("fp").alias("fp")), "classes")
    keys = prints.select("digest", "n", F.element_at("keys", -1).alias("last"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high")
    hits = materialize(keys.join(shared, "key").distinct(), "hits")
    # `met`: how many of a class's keys any other class has. The hub of a group is the member with the least share of
    # keys that no other has, as the text that near copies were made from is.
    hits = materialize(hits.join(hits.groupBy("digest").agg(F.count("*").alias("met")), "digest"), "hits")
    hubs = hits.groupBy("key").agg(F.max(F.struct((F.col("met") / F.col("n")).alias("share"), "digest")).alias("_hub")).select("key", F.col("_hub.digest").alias("hub"))
    hits = materialize(hits.join(hubs, "key"), "hits")

    # A class meets those that it shares most keys with, of the hubs, first and last members of its groups.
    candidates = _alike(classes, radius)
    for end in ("hub", "low", "high"):
        met = hits.filter(f"digest <> {end}").groupBy("digest", F.col(end).alias("other"), "n").count().filter("20 * count >= n")
        best = met.groupBy("digest").agg(F.max(F.struct("count", "other")).alias("_best"))
        candidates = candidates.union(best.select(F.least("digest", "_best.other").alias("u"), F.greatest("digest", "_best.other").alias("v")))
    first = _linked(candidates.distinct(), docs, classes)
    roots = components(first).withColumnsRenamed({"u": "digest", "v": "root"})

    placed = materialize(hits.select("key", "digest", "n", "last", "met").join(roots, "digest", "left").withColumn("comp", F.coalesce("root", "digest")).drop("root"), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("key")
    # A pair's keys are counted once each: those of large groups by the group of the first of them, others one by one.
    within = placed.join(mixed, "key", "left_semi")
    sizes = within.groupBy("key").agg(F.count("*").alias("size"))
    large = materialize(within.join(sizes.filter(F.col("size") > MANY).select("key"), "key", "left_semi"), "large")
    lists = large.groupBy("digest").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    none = F.array().cast("array<long>")
    both = within.join(sizes.filter(F.col("size") <= MANY).select("key"), "key", "left_semi").withColumn("keys", none).unionByName(large.join(lists, "digest"))
    groups = both.groupBy("key").agg(F.collect_list(F.struct("digest", "n", "last", "comp", "met", "keys")).alias("members"))
    many = MANY
    pairs = groups.select("key", "members").mapInArrow(lambda batches: _across(batches, many), "u long, v long, c long, need long").groupBy("u", "v").agg(F.sum("c").alias("c"), F.min("need").alias("need")).filter("c >= need").select("u", "v")
    second = _linked(pairs, docs, classes)

    ends = components(first.union(second)).withColumnsRenamed({"u": "digest", "v": "root"})
    rooted = materialize(classes.join(ends, "digest", "left").select("digest", "first", F.coalesce("root", "digest").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select("digest", "least")
    return prints.select("doc_id", "row", "digest").join(named, "digest").select("doc_id", "row", F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Of each group of near-duplicates one row, that of the smallest id, with all its columns, whatever their names."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with Scope() as scope:
        groups = scope.keep(materialize(near_texts(narrow, radius).filter("kept").groupBy("doc_id", "row").agg(F.count("*").alias("times")), "groups"))

    def rows_of(wanted: DataFrame) -> DataFrame:
        return held.join(wanted, F.col("held").getField(id_col).eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("held").getField(text_col)) == F.col("row")), "left_semi")

    twice = groups.filter("times > 1")
    if twice.isEmpty():
        return rows_of(groups).select("held.*")
    # Rows that are equal in id and text: a number for each, written with it, tells them apart, and the least one stays.
    numbered = rows_of(twice).select("held", F.col("held").getField(id_col).alias("doc_id"), F.xxhash64(F.col("held").getField(text_col)).alias("row"), F.monotonically_increasing_id().alias("number"))
    numbered = materialize(numbered, "numbered")
    least = numbered.groupBy("doc_id", "row").agg(F.min("number").alias("number")).select("number")
    return rows_of(groups.filter("times = 1")).select("held.*").unionByName(numbered.join(least, "number", "left_semi").select("held.*"))
