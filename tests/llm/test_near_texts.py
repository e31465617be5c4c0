"""The pipeline's near-duplicates against the exact Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from inkwell.llm import jaccard, simhash
from tests.llm.test_operators import brute_print, passage


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(text, seed, n):
    words, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def brute_components(rows):
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]) and parent[i] != parent[j]:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    return [(i, min((rows[k][0] for k in range(len(rows)) if parent[k] == p and rows[k][0] is not None), default=None)) for (i, _), p in zip(rows, parent, strict=True)]


def cases():
    base = [passage(1000 + k, 200 + 30 * k) for k in range(6)]
    line = passage(7, 40)
    texts = [None, "", "a b", "A  b", "a b c d e f", passage(3, 9), *base]
    texts += [edited(base[k % 6], 50 + k, 1 + k % 9) for k in range(60)]
    texts += [edited(edited(base[0], 3, 4), 4, 5), line, *(f"{line} {passage(500 + k, 8)}" for k in range(12)), *(f"{line} {passage(600 + k, 60)}" for k in range(12))]
    rows = list(enumerate(texts))
    return [*rows, rows[8], rows[8], (7, base[3]), (None, base[2]), (None, "no other")]


def test_near_texts(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.near_texts(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)
    assert jaccard.near_texts(docs.limit(0)).count() == 0


def test_near_texts_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 1)
    monkeypatch.setattr(jaccard, "LISTED", 300)
    rows = cases()
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)


@pytest.mark.parametrize("many", [1, 3])
def test_near_texts_in_large_groups(spark, monkeypatch, many):
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "RADIUS", 0)
    base = [passage(2000 + k, 60) for k in range(3)]
    rows = list(enumerate([*base, *(edited(base[k % 3], 300 + k, 1 + k % 4) for k in range(60)), *(f"{base[0]} {passage(700 + k, 6 + k)}" for k in range(12))]))
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), radius=0).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_simhash_in_panels(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PANELS", 5)
    texts = [passage(k, 40) for k in range(500)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[:100]] + [t + f" z{k}" for k, t in enumerate(texts[50:150])]
    prints = [brute_print(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 12 and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), radius=12).collect()}
    assert got == dict(enumerate(parent)) and len(set(parent)) < 600


def test_stage_drops_copies_beyond_three_bits(spark):
    a = passage(1, 300)
    b = edited(a, 1, 5)
    assert near(brute_set(a), brute_set(b)) and (brute_print(a) ^ brute_print(b)).bit_count() > 3
    docs = spark.createDataFrame([(1, a), (2, b), (3, passage(2, 300))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_dup_stage(spark, docs, "").collect()) == [1, 3]
