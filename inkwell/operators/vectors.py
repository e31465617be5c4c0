"""Exact vector search over ARRAY<FLOAT> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Queries and rows that meet in one task, at most about, and queries whose scores are held at once.
QUERY_PANEL, ROW_PANEL, HELD = 1024, 16384, 256


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, by: str | None = None) -> DataFrame:
    """(qid, vec_id, score, rank): the k greatest dot products of each query, ties by vec_id.

    corpus has vec_id and embedding, queries qid and embedding, of unit vectors; with `by`, a column of the corpus, the
    k greatest for each of its values. Queries and rows are dealt in panels by hash, and every pair of panels is one
    task, which multiplies two matrices of bounded size and returns its k best of each query. Nothing is collected or
    broadcast, so queries may be as many as rows; what is sent grows with rows times panels of queries.
    """
    n_queries, n = queries.count(), corpus.count()
    across, down = max(1, -(-n_queries // QUERY_PANEL)), max(1, -(-n // ROW_PANEL), min(8, n // HELD))
    kind = corpus.schema[by].dataType.simpleString() if by else "int"
    group = F.col(by) if by else F.lit(0)
    q = queries.select("qid", "embedding").withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(across)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    c = corpus.select("vec_id", "embedding", group.cast(kind).alias("kind")).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [pa.table({"qid": pa.array([], pa.int64()), "kind": pa.array([], rows.schema.field("kind").type), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if asked.num_rows and rows.num_rows:
            qids, ids, kinds = asked.column("qid").to_numpy(), rows.column("vec_id").to_numpy(), rows.column("kind").combine_chunks()
            wanted, held = matrix(asked), matrix(rows)
            codes = kinds.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            members = [np.flatnonzero(codes == x) for x in np.unique(codes[~np.isnan(codes)] if codes.dtype.kind == "f" else codes)]
            for at in range(0, len(qids), HELD):
                some = qids[at : at + HELD]
                for own in members:
                    scores = (wanted[at : at + HELD] @ held[own].T).round(6)
                    if exclude_self:
                        scores[some[:, None] == ids[own][None]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids[own], scores.shape), -scores), axis=1)[:, :k]
                    best = np.take_along_axis(scores, order, 1)
                    good = np.isfinite(best)
                    found = own[order[good]]
                    parts.append(pa.table({"qid": pa.array(np.repeat(some, good.sum(1))), "kind": kinds.take(pa.array(found)), "vec_id": pa.array(ids[found]), "score": pa.array(best[good])}))
        return pa.concat_tables(parts)

    partial = q.groupBy("a", "b").cogroup(c.groupBy("a", "b")).applyInArrow(search, f"qid long, kind {kind}, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "kind").orderBy(F.col("score").desc(), "vec_id"))
    ranked = partial.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("kind", by) if by else ranked.drop("kind")


def best_per_group(scored: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of greatest score in each group, the least `tie` among equals."""
    rest = [c for c in scored.columns if c not in by]
    picked = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie)))
    return scored.groupBy(*by).agg(picked.alias("_best")).select(*by, "_best.*")


def kept_kinds(vectors: DataFrame, kinds: list[str], excluded: list[str], kind: str = "vector_kind", owner: str = "equation_id") -> DataFrame:
    """Vectors of the kinds asked for whose owner is not excluded; a null owner is never excluded."""
    return vectors.filter(F.col(kind).isin(kinds) & (F.col(owner).isNull() | ~F.col(owner).isin(excluded)))


def candidate_vectors(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add `embedding` to candidates (paper_id, sentence_id, chunk_id, ...): their sentence's vector, else their chunk's, else null.

    vectors: paper_id, vector_kind, sentence_id, chunk_id, embedding; of several for one id the last kind by name counts once.
    """
    by_sentence = vectors.filter("sentence_id is not null").groupBy("paper_id", "sentence_id").agg(F.max_by("embedding", F.struct("vector_kind", "chunk_id")).alias("_s"))
    by_chunk = vectors.filter("chunk_id is not null").groupBy("paper_id", "chunk_id").agg(F.max_by("embedding", "vector_kind").alias("_c"))
    joined = candidates.join(by_sentence, ["paper_id", "sentence_id"], "left").join(by_chunk, ["paper_id", "chunk_id"], "left")
    return joined.withColumn("embedding", F.coalesce("_s", "_c")).drop("_s", "_c")


def chunk_texts(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text and sentence_id to retrieved rows (chunk_id, sentence_id, source_text): those of the chunk, unless it is unknown or has none."""
    own = chunks.select("chunk_id", F.col("text").alias("_t"), F.col("sentence_id").alias("_s"))
    joined = rows.join(own, "chunk_id", "left")
    return joined.withColumns({"text": F.coalesce(F.nullif("_t", F.lit("")), F.col("source_text"), F.lit("")), "sentence_id": F.coalesce(F.nullif("sentence_id", F.lit("")), F.col("_s"), F.col("chunk_id"))}).drop("_t", "_s")


def paper_space(equation_rows: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """The vectors of a paper's equations and of its chunks in one table, numbered within the paper, equations first."""
    both = equation_rows.withColumn("_family", F.lit(0)).unionByName(chunk_rows.withColumn("_family", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_family"), F.col("equation_id").asc_nulls_last(), F.col("vector_kind"), F.col("chunk_id"), F.col("sentence_id"), F.col("context_distance")]
    return both.withColumn("row", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order)) - 1).drop("_family")
