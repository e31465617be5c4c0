"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over the words of a text (single spaces between them). A chunk ends after a word whose hash
is the least among those of REACH words on either side, so where chunks end depends on the words nearby only, and an
insertion moves the ends around it and no others. Chunks are deduplicated by digest over the corpus: a digest found
in two documents or more is repeated, and belongs to the document with the smallest id. Repeated chunks that follow
one another are joined to spans, and spans of at least `min_words` words count as repeated passages.

Digests are counted with a partial aggregation before the shuffle, so a passage in any share of the documents costs
one row for each task; the joins are equi-joins that can spill and whose hot keys adaptive execution splits. What is
cut from a text is cut by column expressions, so whole texts pass through Python once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SLICE_ROWS, batch_of, let, map_batches
from inkwell.scratch import Scope, materialize

REACH = 3
#: Words that a passage must have to be told from common phrases: chunks cover a passage but for its two ends.
MIN_WORDS = 20
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte], modulo 2^32 over the last 16 bytes, at every byte."""
    h = GEAR[data]
    for s in (1, 2, 4, 8):
        shifted = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += shifted
    return h


def chunks(text: str) -> tuple[list[int], list[int]]:
    """First words of the chunks (and, last, the number of words), and the chunks' digests as signed longs."""
    words = text.encode().split()
    if not words:
        return [0], []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    h = gear_hashes(np.frombuffer(joined, np.uint8))[ends - 1].astype(np.int64)
    wide = np.pad(h, REACH, constant_values=1 << 40)
    least = np.ones(len(h), bool)
    for k in range(1, REACH + 1):
        least &= (h < wide[REACH - k : REACH - k + len(h)]) & (h <= wide[REACH + k : REACH + k + len(h)])
    cut = (np.flatnonzero(least) + 1).tolist()
    if not cut or cut[-1] != len(words):
        cut.append(len(words))
    stops = ends[np.array(cut) - 1].tolist()
    starts = [0, *[b + 1 for b in stops[:-1]]]
    return [0, *cut], [d - (1 << 64) if d >> 63 else d for d in (xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, stops, strict=True))]


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), digest, at (first word), n (words), again (the digest came earlier in the same text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, digest, at, n, again = [], [], [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            starts, digests = chunks(text or "")
            seen: set[int] = set()
            for a, b, d in zip(starts, starts[1:], digests, strict=False):
                again.append(d in seen)
                seen.add(d)
                at.append(a)
                n.append(b - a)
            digest += digests
            row += [k] * len(digests)
        rows = pa.array(row, pa.int64())
        return batch_of(doc_id=batch.column("doc_id").take(rows), row=batch.column("row").take(rows), digest=pa.array(digest, pa.int64()), at=pa.array(at, pa.int32()), n=pa.array(n, pa.int32()), again=pa.array(again, pa.bool_()))

    plain = docs.selectExpr(f"`{id_col}` as doc_id", f"xxhash64(`{text_col}`) as row", f"`{text_col}` as text")
    return map_batches(plain, lambda: work, f"doc_id {kind}, row long, digest long, at int, n int, again boolean")


def _spans(marked: list[dict], wanted, min_words: int) -> list[list[int]]:
    """[first word, end] of runs of adjoining chunks for which `wanted` holds, if long enough."""
    out: list[list[int]] = []
    for c in marked:
        if wanted(c):
            if out and out[-1][1] == c["at"]:
                out[-1][1] += c["n"]
            else:
                out.append([c["at"], c["at"] + c["n"]])
    return [s for s in out if s[1] - s[0] >= min_words]


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (id and text) that holds a passage of `min_words` or more found in another document.

    doc_id, repeated (true), n_spans, n_repeat_words, n_removed_words, first_doc_ids (documents that keep what this
    one repeats), spans and removed (arrays of first word and end). Passages are removed from all documents but the
    one with the smallest id. Rows that share an id do not repeat each other, and each of their texts has its own
    spans; a row with a null id is a document after all others. Null and empty texts repeat nothing; an empty table gives an empty result.
    """
    return _passages(docs, min_words, id_col, text_col).drop("row")


def _passages(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """repeated_passages() with `row`, the hash of the text that the spans are of."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = materialize(chunk_table(docs, id_col, text_col), "chunks")
    held = table.filter(~F.col("again")).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    owners = held.filter("first < last or unnamed > 1 or (unnamed = 1 and first is not null)").select("digest", "first")
    hits = table.join(owners, "digest").select("doc_id", "row", "at", "n", "first")
    # A row present twice has every chunk twice: a set holds it once.
    listed = hits.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("at", "n", "first"))).alias("marked"))

    def assemble(batches):
        for big in batches:
            for start in range(0, big.num_rows, SLICE_ROWS):
                batch = big.slice(start, SLICE_ROWS)
                rows = []
                for k, (doc_id, marked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), strict=True)):
                    spans = _spans(marked, lambda c: True, min_words)
                    removed = _spans(marked, lambda c: c["first"] is not None and c["first"] != doc_id, min_words)  # noqa: B023
                    if spans:
                        firsts = sorted({c["first"] for c in marked if c["first"] not in (None, doc_id) and any(a <= c["at"] < b for a, b in spans)})
                        total = lambda x: sum(b - a for a, b in x)
                        rows.append((k, True, len(spans), total(spans), total(removed), firsts, spans, removed))
                c = list(zip(*rows, strict=True)) or [()] * 8
                pairs, ids = pa.list_(pa.list_(pa.int32())), batch.column("doc_id")
                picked = pa.array(c[0], pa.int64())
                yield batch_of(
                    doc_id=ids.take(picked), row=batch.column("row").take(picked), repeated=pa.array(c[1], pa.bool_()), n_spans=pa.array(c[2], pa.int32()), n_repeat_words=pa.array(c[3], pa.int64()),
                    n_removed_words=pa.array(c[4], pa.int64()), first_doc_ids=pa.array(c[5], pa.list_(ids.type)), spans=pa.array(c[6], pairs), removed=pa.array(c[7], pairs),
                )

    schema = f"doc_id {kind}, row long, repeated boolean, n_spans int, n_repeat_words long, n_removed_words long, first_doc_ids array<{kind}>, spans array<array<int>>, removed array<array<int>>"
    return listed.mapInArrow(assemble, schema)


def _without(text: Column, removed: Column) -> Column:
    """The text without the words of the ranges, and without the white space after them."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def left(parts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r[1]))
        ends = F.concat(F.transform(removed, lambda r: r[0]), F.array(F.size(parts)))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), "")), "")

    return F.concat(F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0), let(words, left))


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without what they repeat from documents with smaller ids; what has no words left is dropped.

    Other columns stay as they are, whatever their names, and so do rows that repeat nothing, null and empty texts
    among them. Rows that share an id are cut each by its own text. An empty table stays empty.
    """
    with Scope() as scope:
        found = scope.keep(materialize(_passages(docs, min_words, id_col, text_col).filter("n_removed_words > 0").select("doc_id", "row", "removed"), "removed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    text = F.col("held").getField(text_col)
    joined = rows.join(found, F.col("held").getField(id_col).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("row")), "left")
    cut = F.when(F.col("removed").isNotNull(), _without(text, F.col("removed"))).otherwise(text)
    kept = joined.select("held", "removed", cut.alias("cut")).filter(F.col("removed").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[(F.col("cut") if c == text_col else F.col("held").getField(c)).alias(c) for c in docs.columns])
