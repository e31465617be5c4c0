"""Equation meanings from gathered candidates: one scored additively, one by a weighted blend (K3)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import meaning
from inkwell.functions.text import squeeze
from inkwell.operators import retrieval
from inkwell.operators.quality import hard_filter_reasons, penalty
from inkwell.scratch import materialize

# Cue patterns, weights and limits that decide the results. {label} is the equation's number.
CUES = (
    r"(?i)\b(?:Eq\.?|Equation)\s*\(?\s*\Q{label}\E\s*\)?\s+(?:states|gives|defines|describes|represents|is)\b",
    r"(?i)\(\s*\Q{label}\E\s*\)\s+(?:gives|states|defines|describes|represents|is)\b",
    r"(?i)\b(?:is\s+defined\s+as|is\s+given\s+by|represents|describes|denotes)\b",
)
SOURCE_BONUS = {"cross_reference": 1.0, "cue_pattern": 0.7, "bm25_retrieval": 0.55, "proximity": 0.4}
BLEND = {"cosine": 0.5, "bm25": 0.2, "source": 0.2, "proximity": 0.1}
K1, B, RETRIEVED = 1.2, 0.75, 20

Reranker = Callable[[str, str, list[str]], list[float]]


def command_tokens(text: Column) -> Column:
    """Words, commands and numbers in lower case, without backslashes (X6, second form)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|\\[A-Za-z]+|[0-9]+"), F.lit(0)), lambda t: F.ltrim(F.lower(t), F.lit("\\")))


def has_cue(text: Column, label: Column) -> Column:
    quoted = [F.concat(*[label if part == "{label}" else F.lit(part) for part in (*c.partition("{label}"),) if part]) if "{label}" in c else F.lit(c) for c in CUES]
    out = F.regexp_like(text, quoted[0])
    for q in quoted[1:]:
        out = out | F.regexp_like(text, q)
    return out


def bm25_within(rows: DataFrame, group: list[str], query: Column, text: Column) -> DataFrame:
    """Add bm25: each row's score for its group's query over the best of the group; statistics are the group's rows."""
    w = Window.partitionBy(*group)
    # The rows' numbers are written with them: two branches would otherwise number the rows each for itself.
    numbered = materialize(rows.withColumns({"_id": F.monotonically_increasing_id(), "_t": command_tokens(text), "_q": command_tokens(query)}), "within")
    base = numbered.withColumns({"_n": F.count("*").over(w), "_mean": F.avg(F.size("_t")).over(w)})
    terms = base.select(*group, "_id", "_n", "_mean", F.greatest(F.size("_t"), F.lit(1)).alias("_dl"), "_t", "_q", F.explode(F.array_distinct(F.array_intersect("_t", "_q"))).alias("_term"))
    count = lambda a: F.size(F.filter(a, lambda x: x == F.col("_term")))
    terms = terms.withColumns({"_tf": count("_t"), "_qf": count("_q"), "_df": F.count("*").over(Window.partitionBy(*group, "_term"))})
    gain = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)) * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_dl") / F.greatest("_mean", F.lit(1e-9)))) * F.col("_qf")
    scores = terms.groupBy("_id").agg(F.sum(gain).alias("_s"))
    out = base.join(scores, "_id", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    best = F.max("_s").over(w)
    return out.withColumn("bm25", F.when(best > 0, F.col("_s") / best).otherwise(0.0)).drop("_id", "_t", "_q", "_n", "_mean", "_s")


def gather_candidates(equations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, equation_id, pos, source, text, sentence_id, document_order, retrieval_score), first of equal texts only.

    equations: paper_id, equation_id, label, anchor_id, latex, document_order, before (array of sentence_id, text).
    Candidates come, in this order, from cross-references to the label, sentences before with a cue, neighbourhoods
    with a cue, and the best of the paper's sentences by BM25; the sentence right before counts if there is none.
    """
    key = ["paper_id", "equation_id"]
    named = equations.select("*", F.coalesce("label", "equation_id").alias("_label"), F.coalesce("document_order", F.lit(0)).alias("_at"))
    shape = lambda df, rank, source, pos, order=F.col("document_order"), score=F.lit(0.0): df.select(*key, F.struct(F.lit(rank).alias("rank"), pos.alias("key")).alias("pos"), F.lit(source).alias("source"), squeeze(F.col("text")).alias("text"), "sentence_id", order.alias("document_order"), score.alias("retrieval_score"))
    here = lambda *kinds: chunks.filter(F.col("chunk_type").isin(*kinds))
    own = named.select(*key, "label", "_label", "_at", "anchor_id")
    cited = own.join(here("cross_reference").select("paper_id", F.explode("visible_equation_labels").alias("label"), "text", "sentence_id", "document_order", "chunk_id"), ["paper_id", "label"])
    before = named.select(*key, "_label", "_at", F.posexplode("before").alias("_k", "_s")).select(*key, "_label", "_at", F.col("_k").cast("string").alias("_k"), "_s.text", "_s.sentence_id")
    around = own.join(here("raw_equation_neighborhood").select("paper_id", F.col("raw_equation_anchor").alias("anchor_id"), "text", "sentence_id", "document_order", "chunk_id"), ["paper_id", "anchor_id"])
    last_two = F.transform(F.slice("before", -2, 2), lambda s: s["text"])
    two = F.when(F.size("before") >= 2, last_two).otherwise(F.transform("before", lambda s: s["text"]))
    query = F.concat_ws(" ", "latex", F.concat(F.lit("Equation "), "_label"), two)
    pool = named.select(*key, query.alias("_query")).join(here("sentence", "raw_equation_neighborhood").filter(F.trim("text") != "").select("paper_id", "text", "sentence_id", "document_order", "chunk_id"), "paper_id")
    ranked = bm25_within(pool, key, F.col("_query"), F.col("text")).filter("bm25 > 0")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("bm25").desc(), F.abs("document_order"), "chunk_id"))
    kept = ranked.withColumn("_p", place).filter(F.col("_p") <= RETRIEVED)
    parts = [
        shape(cited, 0, "cross_reference", F.col("chunk_id")),
        shape(before.filter(has_cue(F.col("text"), F.col("_label"))), 1, "cue_pattern", F.col("_k"), F.col("_at")),
        shape(around.filter(has_cue(F.col("text"), F.col("_label"))), 2, "cue_pattern", F.col("chunk_id")),
        shape(kept, 3, "bm25_retrieval", F.format_string("%04d", "_p"), score=F.col("bm25")),
        shape(before.withColumn("_last", F.max(F.col("_k").cast("int")).over(Window.partitionBy(*key))).filter("_k = _last"), 4, "proximity", F.col("_k"), F.col("_at")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.filter("text <> ''")
    fallback = F.min(F.col("pos")["rank"]).over(Window.partitionBy(*key)) == 4
    union = union.withColumn("_only", fallback).filter((F.col("source") != "proximity") | F.col("_only")).drop("_only")
    firsts = F.row_number().over(Window.partitionBy(*key, F.lower("text")).orderBy("pos"))
    return union.withColumn("_f", firsts).filter("_f = 1").drop("_f")


def meanings_by_blend(equations: DataFrame, candidates: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """(paper_id, equation_id, meaning, source_sentence_id, score, match_source, candidate_count, hard_filter_reasons).

    Half cosine similarity (rescaled; 0 if unknown), a fifth BM25 of the equation's LaTeX among the candidates, a
    fifth the source's bonus, a tenth proximity in document order, less a penalty for each reason against the text
    (A18, Q3). Equations without candidates have an empty meaning. similarities: paper_id, equation_id, sentence_id,
    cosine.
    """
    key = ["paper_id", "equation_id"]
    own = equations.select(*key, "latex", F.coalesce("document_order", F.lit(0)).alias("_at"))
    rows = bm25_within(candidates.join(own, key), key, F.col("latex"), F.col("text"))
    if similarities is None:
        rows = rows.withColumn("cosine", F.lit(None).cast("double"))
    else:
        rows = rows.join(similarities, [*key, "sentence_id"], "left")
    reasons = hard_filter_reasons(F.col("text"))
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_BONUS.items() for x in p]), F.col("source")), F.lit(0.0))
    near = 1.0 / (1.0 + F.abs(F.coalesce(F.nullif("document_order", F.lit(0)), "_at") - F.col("_at")))
    score = BLEND["cosine"] * F.coalesce((F.col("cosine") + 1) / 2, F.lit(0.0)) + BLEND["bm25"] * F.col("bm25") + BLEND["source"] * bonus + BLEND["proximity"] * near - penalty(reasons)
    scored = rows.withColumns({"score": score, "hard_filter_reasons": reasons})
    best = F.max_by(F.struct("text", "sentence_id", "score", "source", "hard_filter_reasons"), F.struct("score", -F.size("hard_filter_reasons"), "retrieval_score", "text"))
    picked = scored.groupBy(*key).agg(best.alias("_b"), F.count("*").alias("candidate_count"))
    out = equations.select(*key).join(picked, key, "left")
    return out.select(
        *key, F.coalesce("_b.text", F.lit("")).alias("meaning"), F.col("_b.sentence_id").alias("source_sentence_id"), F.coalesce(F.round("_b.score", 4), F.lit(0.0)).alias("score"),
        F.coalesce("_b.source", F.lit("none")).alias("match_source"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("_b.hard_filter_reasons", F.array().cast("array<string>")).alias("hard_filter_reasons"),
    )


def meaning_of(equation_id: str, query: str, results: list[dict], rerank: Reranker | None = None) -> dict:
    """The meaning of one equation from ranked chunks (dicts with chunk_id, text, score), scored additively.

    Equal candidates count once, in the slot of the first, with the adjacent and better placed one kept (A11). The
    best candidate must reach ACCEPTED_SCORE; below that a reranker's favourite is taken, if there is a reranker
    (D1, D10), else the meaning is empty.
    """
    best_retrieval = max((r["score"] for r in results), default=0.0)
    slots: dict[str, tuple] = {}
    for rank, r in enumerate(results, 1):
        near = r.get("nearby_equation_ids") or []
        exact = bool(near) and r["chunk_id"].endswith(f":equation_neighborhood:{near[0]}")
        for text, position in meaning.candidates(r["text"], equation_id):
            new = (int(position in meaning.ADJACENT) + int(exact), r["score"], text, position, r["chunk_id"], -rank)
            key = " ".join(text.split()).casefold()
            if key not in slots or new[:2] > slots[key][:2]:
                slots[key] = new
    found = list(slots.values())
    empty = {"meaning": "", "strategy": "no_reliable_candidate", "confidence": 0.0, "source_text": "", "features": {}, "reasons": []}
    if not found:
        return empty
    given = rerank(equation_id, query, [c[2] for c in found]) if rerank else None
    if given is not None and len(given) != len(found):
        raise ValueError("a reranker must return one score for each candidate")
    low, high = (min(given), max(given)) if given else (0.0, 0.0)
    scaled = [0.5 if high - low <= 1e-8 else (g - low) / (high - low) for g in given] if given else [None] * len(found)
    rated = []
    for k, (_, score, text, position, chunk_id, rank) in enumerate(found):
        parts = meaning.features(text, position, chunk_id, equation_id, score / best_retrieval if best_retrieval > 0 else 0.0, scaled[k])
        rated.append({"score": sum(parts.values()), "raw": given[k] if given else 0.0, "rank": rank, "text": text, "position": position, "features": parts})
    best = max(rated, key=lambda x: (x["score"], x["rank"], x["text"]))
    fallback = best["score"] < meaning.ACCEPTED_SCORE
    if fallback and not given:
        return empty
    if fallback:
        best = max(rated, key=lambda x: (x["raw"], x["rank"], x["text"]))
    span, strategy = meaning.extract_span(best["text"], equation_id, best["position"])
    reasons = meaning.filter_reasons(best["text"], strategy, best["position"])
    return {"meaning": span, "strategy": strategy, "selection": "mathbert_fallback" if fallback else "combined_score", "confidence": round(best["score"], 4), "source_text": best["text"], "features": best["features"], "reasons": reasons}


SEARCHED_KINDS = ("sentence", "paragraph", "equation_neighborhood")


def batch_search(chunks: DataFrame, equations: DataFrame, method: str = "bm25", top_k: int = 10, kinds: tuple[str, ...] = SEARCHED_KINDS) -> DataFrame:
    """The evidence of every equation of every paper in one search: lexical_search() with a query for each (K2).

    equations: paper_id, equation_id, text (its query), tokens. Chunks must be near the equation and of `kinds`.
    """
    none = F.lit(None).cast("array<string>")
    asked = equations.select(
        F.concat_ws("/", "paper_id", "equation_id").alias("qid"), "paper_id", "tokens", F.lit(top_k).alias("top_k"), none.alias("section_ids"),
        F.array(*map(F.lit, kinds)).alias("chunk_types"), F.array("equation_id").alias("equation_ids"), none.alias("symbol_names"),
    )
    return lexical_search(chunks, asked, method)


def first_meanings(queries: DataFrame, results: DataFrame, rerank: Callable[[], Reranker] | None = None) -> DataFrame:
    """meaning_of() for every equation, as a DataFrame operator (K3 first generation, D1, D10).

    queries: paper_id, equation_id, text. results: paper_id, equation_id, rank, score, chunk_id, text,
    nearby_equation_ids: the top k of batch_search(), so one row holds an equation's. `rerank` makes a reranker once
    for each task.
    """
    key = ["paper_id", "equation_id"]
    listed = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id", "text", "nearby_equation_ids"))).alias("results"))
    schema = "paper_id string, equation_id string, meaning string, strategy string, selection string, confidence double, source_text string, reasons array<string>"

    def run(frames):
        ranker = rerank() if rerank else None
        for frame in frames:
            rows = []
            for q in frame.to_dict("records"):
                found = [] if q["results"] is None or isinstance(q["results"], float) else [dict(r, nearby_equation_ids=list(r["nearby_equation_ids"] if r["nearby_equation_ids"] is not None else ())) for r in q["results"]]
                done = meaning_of(q["equation_id"], q["text"] or "", found, ranker)
                rows.append((q["paper_id"], q["equation_id"], done["meaning"], done["strategy"], done.get("selection", "none"), float(done["confidence"]), done["source_text"], list(done["reasons"])))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return queries.select(*key, "text").join(listed, key, "left").mapInPandas(run, schema)


def lexical_search(chunks: DataFrame, queries: DataFrame, method: str = "bm25") -> DataFrame:
    """Ranked chunks for queries with metadata filters (K1, K2, P1): qid, rank, score, method, and the chunk's columns.

    chunks: chunk_id, paper_id, chunk_type, text, section_id, nearby_equation_ids, symbols, tokens. queries: qid, text,
    paper_id, tokens, top_k and the filter lists section_ids, chunk_types, equation_ids, symbol_names; null filters
    nothing. Statistics are those of all chunks, before the filters (Q4).
    """
    scorers = {"bm25": retrieval.bm25, "tfidf": retrieval.tfidf}
    if method not in scorers:
        raise ValueError(f"unknown method: {method}")
    if chunks.isEmpty():
        raise ValueError("the index is empty")
    docs = chunks.withColumnRenamed("chunk_id", "doc_id")
    scored = scorers[method](docs.select("doc_id", "tokens"), queries.select("qid", "tokens"))
    asked = queries.select("qid", F.col("paper_id").alias("_paper"), "top_k", "section_ids", "chunk_types", "equation_ids", "symbol_names")
    joined = scored.join(docs.drop("tokens"), "doc_id").join(asked, "qid")
    kept = joined.filter(
        (F.col("paper_id") == F.col("_paper")) & retrieval.among(F.col("section_id"), F.col("section_ids")) & retrieval.among(F.col("chunk_type"), F.col("chunk_types"))
        & retrieval.overlaps(F.col("nearby_equation_ids"), F.col("equation_ids")) & retrieval.overlaps(F.col("symbols"), F.col("symbol_names"))
    )
    ranked = retrieval.top_k(kept, F.col("top_k"))
    return ranked.withColumn("method", F.lit(method)).withColumnRenamed("doc_id", "chunk_id").drop("_paper", "top_k", "section_ids", "chunk_types", "equation_ids", "symbol_names")
