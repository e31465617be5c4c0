"""Vectors of equations, their surroundings and sentences.

The inputs keep within token budgets. The encoder is a parameter; HashedEncoder, the default, needs no model: it
adds up hashed token vectors, so equal texts have equal vectors and shared words bring texts close.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Budgets and sizes that decide the results.
MAX_TOKENS, SPECIAL_TOKENS, SUMMARY_EQUATION, SENTENCE_EQUATION, SIZE = 512, 2, 256, 320, 768
ROOM, CUT = MAX_TOKENS - SPECIAL_TOKENS, " [...] "


class WordTokenizer:
    """White-space pieces with what precedes them, so that decoding gives the text back."""

    def encode(self, text: str) -> list[str]:
        return re.findall(r"\s*\S+", text)

    def decode(self, tokens: Sequence[str]) -> str:
        return "".join(tokens)


def keep_ends(tok, text: str, budget: int) -> tuple[str, bool]:
    """The first and last half of the budget, with a mark between, if the text is longer."""
    ids = tok.encode(text)
    if len(ids) <= budget:
        return text, False
    half = budget // 2
    return tok.decode(ids[:half]) + CUT + tok.decode(ids[half - budget :]), True


def keep_head(tok, text: str, budget: int) -> tuple[str, bool]:
    ids = tok.encode(text)
    return (text, False) if len(ids) <= budget else (tok.decode(ids[:budget]), True)


def keep_tail(tok, text: str, budget: int) -> tuple[str, bool]:
    ids = tok.encode(text)
    return (text, False) if len(ids) <= budget else (tok.decode(ids[-budget:]), True)


def equation_input(tok, latex: str) -> tuple[str, bool]:
    return keep_ends(tok, f"equation: {latex}", ROOM)


def _equation_part(tok, latex: str, budget: int) -> tuple[str, bool]:
    part, cut = keep_ends(tok, f"equation: {latex}", budget)
    return (f"equation: {part}" if cut else part), cut


def summary_input(tok, latex: str, before: list[str], after: list[str]) -> tuple[str, bool, bool]:
    """before, equation, after: the context nearest the equation, room that one side leaves going to the other."""
    used = min(SUMMARY_EQUATION, len(tok.encode(f"equation: {latex}")))
    part, cut = _equation_part(tok, latex, used)
    half = (ROOM - used) // 2
    left, right = tok.encode(" ".join(before)), tok.encode(" ".join(after))
    spare_left, spare_right = half - min(len(left), half), half - min(len(right), half)
    n_left, n_right = min(len(left), half + spare_right), min(len(right), half + spare_left)
    told = [("before: ", tok.decode(left[len(left) - n_left :]).strip()), ("", part), ("after: ", tok.decode(right[:n_right]).strip())]
    return "\n".join(name + text for name, text in told if text), cut, len(left) > n_left or len(right) > n_right


def sentence_input(tok, latex: str, sentence: str, position: str, distance: int) -> tuple[str, bool, bool]:
    """equation, context, position and distance; what the sentence leaves goes to the equation."""
    told = f"context: {sentence}\nposition: {position}\ndistance: {distance}"
    length = len(tok.encode(f"equation: {latex}"))
    used = min(SENTENCE_EQUATION, length)
    room = ROOM - used
    spare = max(0, room - len(tok.encode(told)))
    part, cut = _equation_part(tok, latex, min(length, used + spare) if length > used else length)
    if length > used and not cut:
        part, cut = f"equation: {part}{CUT}", True
    told, shortened = keep_head(tok, told, room)
    return f"{part}\n{told}", cut, shortened


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps, at unit length."""
    kept = mask[..., None].astype(states.dtype)
    mean = (states * kept).sum(-2) / np.maximum(kept.sum(-2), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=-1, keepdims=True), 1e-12)


class HashedEncoder:
    """Unit vectors from token hashes: a stand-in for a model, behind the same call."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.known: dict[str, np.ndarray] = {}

    def token(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self.known[word] = np.random.default_rng(seed).standard_normal(self.size).astype(np.float32)
        return self.known[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for k, words in enumerate(re.findall(r"\w+", t.lower()) for t in texts):
            if words:
                out[k] = mean_pool(np.stack([self.token(w) for w in words]), np.ones(len(words)))
        return out


def embed(rows: DataFrame, text: str = "source_text", encoder: Callable[[], Callable[[list[str]], np.ndarray]] = HashedEncoder) -> DataFrame:
    """Add embedding and source_sha256; the encoder is made once for each worker's iterator (SRC10, D6)."""
    @F.pandas_udf("array<float>")
    def vectors(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for s in frames:
            yield pd.Series(list(run([t or "" for t in s])))

    return rows.withColumn("embedding", vectors(text)).withColumn("source_sha256", F.sha2(text, 256))


def equation_inputs(equations: DataFrame, tokenizer: Callable[[], object] = WordTokenizer) -> DataFrame:
    """(paper_id, equation_id, vector_kind, sentence_id, context_position, context_distance, source_text, two flags).

    For each equation its own input, one with the sentences around, and one for each of these, nearest first (W9).
    """
    schema = "paper_id string, equation_id string, vector_kind string, sentence_id string, context_position string, context_distance int, source_text string, equation_truncated boolean, context_truncated boolean"

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer()
        for frame in frames:
            out = []
            for e in frame.itertuples(index=False):
                sides = {"before": [(s["sentence_id"], s["text"]) for s in e.before], "after": [(s["sentence_id"], s["text"]) for s in e.after]}
                text, cut = equation_input(tok, e.latex or "")
                out.append((e.paper_id, e.equation_id, "equation", None, None, 0, text, cut, False))
                text, cut, lost = summary_input(tok, e.latex or "", *[[t for _, t in s] for s in sides.values()])
                out.append((e.paper_id, e.equation_id, "summary", None, None, 0, text, cut, lost))
                for position, told in sides.items():
                    for distance, (sentence_id, sentence) in enumerate(reversed(told) if position == "before" else told, 1):
                        text, cut, lost = sentence_input(tok, e.latex or "", sentence, position, distance)
                        out.append((e.paper_id, e.equation_id, f"{position}_sentence", sentence_id, position, distance, text, cut, lost))
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return equations.select(F.col("paper_id").cast("string").alias("paper_id"), "equation_id", "latex", "before", "after").mapInPandas(build, schema)


EMBEDDED_KINDS = ("sentence", "raw_equation_neighborhood")


def chunk_inputs(chunks: DataFrame, tokenizer: Callable[[], object] = WordTokenizer) -> DataFrame:
    """Inputs for the chunks that are searched by vector: their text, its head if it is too long."""
    @F.pandas_udf("struct<source_text:string,context_truncated:boolean>")
    def head(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok = tokenizer()
        for s in frames:
            yield pd.DataFrame([keep_head(tok, t, ROOM) for t in s], columns=["source_text", "context_truncated"])

    kept = chunks.filter(F.col("chunk_type").isin(*EMBEDDED_KINDS)).withColumn("_t", F.trim("text")).filter("_t <> ''").withColumn("_h", head("_t"))
    none = F.lit(None).cast("string")
    return kept.select(
        F.col("paper_id").cast("string").alias("paper_id"), none.alias("equation_id"), F.lit("sentence_chunk").alias("vector_kind"), "chunk_id", "sentence_id", none.alias("context_position"),
        F.lit(0).alias("context_distance"), "_h.source_text", F.lit(False).alias("equation_truncated"), "_h.context_truncated",
    )


def meaning_similarities(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(paper_id, equation_id, sentence_id, cosine) of candidates with their equation's summary vector, where both have one."""
    from inkwell.functions.arrays import dot
    from inkwell.operators.vectors import candidate_vectors

    summary = vectors.filter("vector_kind = 'summary'").select("paper_id", "equation_id", F.col("embedding").alias("_e"))
    placed = candidate_vectors(candidates.withColumn("chunk_id", F.lit(None).cast("string")), vectors).filter("embedding is not null")
    scored = placed.join(summary, ["paper_id", "equation_id"]).select("paper_id", "equation_id", "sentence_id", dot(F.col("embedding"), F.col("_e")).alias("cosine"))
    return scored.groupBy("paper_id", "equation_id", "sentence_id").agg(F.max("cosine").alias("cosine"))


def summary_similarities(vectors: DataFrame) -> DataFrame:
    """(paper_id, src, dst, similarity) of the summary vectors of a paper's equations."""
    from inkwell.functions.arrays import dot

    own = vectors.filter("vector_kind = 'summary'").select("paper_id", "equation_id", "embedding")
    other = own.select("paper_id", F.col("equation_id").alias("dst"), F.col("embedding").alias("_e"))
    return own.withColumnRenamed("equation_id", "src").join(other, "paper_id").filter("src <> dst").select("paper_id", "src", "dst", dot(F.col("embedding"), F.col("_e")).alias("similarity"))
