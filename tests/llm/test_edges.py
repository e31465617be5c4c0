"""Very long texts, clashing column names and brute-force forms of what the other tests only bound."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline as cp
from inkwell.llm import bpe, fingerprints, licenses, packing, secret_scan, sharding, simhash, substring, toxicity
from inkwell.llm.jaccard import near_texts
from inkwell.llm.quality import quality_rules
from tests.llm.test_operators import brute_print, brute_quality, passage

NAMES = ("_id", "_of", "_row", "_removed", "row", "held", "cut", "removed", "part", "number", "times", "digest", "group", "size", "class", "unit", "hash", "component_id", "kept", "fp")


@pytest.fixture(scope="module")
def long(spark):
    text = passage(5, 150_000)  # a text of about a megabyte
    rows = [(1, text), (2, passage(6, 40)), (3, text + " end"), (4, None), (5, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_long_texts(spark, long):
    rows, docs = long
    texts = {i: t or "" for i, t in rows}
    got = {r["doc_id"]: r for r in quality_rules(docs.withColumn("source", docs["doc_id"].cast("string"))).collect()}
    assert {i: got[i]["n_words"] for i in texts} == {i: brute_quality(t)[0] for i, t in rows}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(docs).collect()} == {i: brute_print(t) for i, t in texts.items() if len(t) < 1000} | {i: simhash.fingerprint(t) for i, t in texts.items() if len(t) >= 1000}
    assert {r["doc_id"]: r["component_id"] for r in near_texts(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
    assert {r["doc_id"]: r["decoded_sha256"] for r in bpe.bpe_digests(docs).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    held = defaultdict(int)
    for r in packing.pack_documents(docs).collect():
        held[r["doc_id"]] += r["length"]
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.bpe_digests(docs).collect()}
    assert dict(held) == {i: k + 1 for i, k in n.items()}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(docs).collect()} == {i: len(t.split()) for i, t in texts.items()}
    assert {r["doc_id"] for r in substring.repeated_passages(docs).collect()} == {1, 3}
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint_documents(docs).collect()} == {i: fingerprints.of_text(t).hex() for i, t in texts.items()}
    assert sum(r["size"] for r in sharding.shard_documents(docs, 3).collect()) == sum(len(t.encode()) + 16 for t in texts.values())
    assert secret_scan.scan_secrets(docs).count() == 5
    assert toxicity.score_toxicity(docs, toxicity.OrdinalModel(np.zeros(toxicity.FEATURES), np.array([0.0, 1.0]))).count() == 5


def test_clashing_columns(spark):
    shared = passage(1, 80)
    texts = [passage(10 + k, 50) + " " + shared + " " + passage(40 + k, 50) for k in range(3)] + [None, "", "too short", passage(90, 60)]
    rows = [(k, t, "en", "src", len(t or ""), *range(len(NAMES))) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (1, passage(77, 70), "en", "src", 0, *range(len(NAMES))), (1, shared + " " + passage(78, 40), "en", "src", 0, *range(len(NAMES)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)).repartition(3)
    for operator in (quality_rules, simhash.near_duplicates, bpe.bpe_digests, packing.token_pieces, licenses.scan_licenses, secret_scan.scan_secrets, fingerprints.fingerprint_documents, sharding.shard_documents):
        assert operator(docs).count() == len(rows), operator
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
        assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in docs.collect()), name
    left = sorted((r["doc_id"], len(r["text"].split())) for r in docs.collect())
    assert [i for i, _ in left] == [0, 1, 1, 1, 2, 6]
    assert cp.STAGES[-1][1](spark, docs, "").count() >= 6


def test_rows_are_judged_one_by_one(spark):
    good = passage(1, 60)
    docs = spark.createDataFrame([(1, good, "s"), (1, "too short", "s"), (None, good, None)], "doc_id long, text string, source string")
    assert sorted(((r["doc_id"], r["text"]) for r in cp.quality_stage(spark, docs, "").collect()), key=repr) == sorted([(1, good), (None, good)], key=repr)


def brute_entropy(text):
    """Entropy spans by recomputing every window, with the text before a candidate looked at whole."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s, before = m[0], text[: m.start()]
        if secret_scan.ALLOWED.fullmatch(s) or secret_scan.NAMED_DIGEST.search(before) or re.search(r"(?i)(?:https?://|www\.)\S*$", before) or not re.search("[0-9]", s):
            continue
        limit = next(x for _, shape, x in secret_scan.CLASSES if shape.fullmatch(s))
        high = []
        for k in range(len(s) - 19):
            counts = Counter(s[k : k + 20])
            if -sum(c / 20 * math.log2(c / 20) for c in counts.values()) >= limit - 1e-12:
                high.append(k)
        if high:
            out.append((m.start() + high[0], m.start() + high[-1] + 20))
    return out


def test_entropy_spans_by_brute_force():
    r = random.Random(8)
    alphabet = ["abcdef0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789", "abcdefgh+/=_-0123456789", "aab", "https://a.b/ ", "www.x ", " sha256: ", "commit "]
    for _ in range(400):
        text = "".join("".join(r.choices(c, k=r.randint(1, 40))) if len(c) > 15 or c == "aab" else c for c in r.choices(alphabet, k=8))
        text = "".join(x + r.choice(["", " ", "\n", "."]) for x in re.findall(r".{1,50}", text))
        assert secret_scan.entropy_spans(text) == brute_entropy(text), text
    far = "https://a.b/p?" + "x/" * 2000 + "q8Zr2LmX9vTb4KpW7sYd"
    assert secret_scan.entropy_spans(far) == [] == brute_entropy(far)


def brute_counters(text):
    out = np.zeros(64)
    for line in text.split("\n"):
        words = line.encode().split()
        for k in range(max(1, len(words) - 2) if words else 0):
            h = xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]))
            out += [1 if h >> (8 * (b // 8) + 7 - b % 8) & 1 else -1 for b in range(64)]
    return out


def test_likeness_by_brute_force():
    texts = [passage(1, 200), passage(1, 150) + " " + passage(2, 50), passage(3, 90) + "\n" + passage(4, 30), "", "a b"]
    for a in texts:
        for b in texts:
            x, y = brute_counters(a), brute_counters(b)
            want = 1.0 if sorted(a.split("\n")) == sorted(b.split("\n")) else min(1, max(0, 2 * x @ y / (x @ x + y @ y))) if (x @ x + y @ y) else 0.0
            assert fingerprints.likeness(fingerprints.of_text(a), fingerprints.of_text(b)) == pytest.approx(want, abs=1e-6)
    for n in (5_000, 40_000):  # the counters do not go round
        whole, half = fingerprints.of_text("x y z " * n), fingerprints.of_text("x y z " * (n // 2))
        assert fingerprints.likeness(whole, half) == pytest.approx(0.8, abs=0.01)


def test_equal_rows_are_spread_over_ranges(spark):
    rows = [(1, "same text")] * 400 + [(2, "other")]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 401 and Counter(r["near_next"] for r in got)[1.0] == 399


def test_ordinal_likelihood():
    r = np.random.default_rng(2)
    docs = [np.unique(r.integers(0, 30, 6)) for _ in range(200)]
    y = r.integers(0, 4, 200)
    row, col = np.repeat(np.arange(200), [len(d) for d in docs]), np.concatenate(docs)
    p = np.concatenate([r.normal(size=30) / 3, [-0.5, 0.4, 1.5]])
    value, grad = toxicity.loss(p, row, col, y, 3, 0.01)
    want = 0.0
    for d, k in zip(docs, y, strict=True):  # P(grade = k) from the thresholds, one document at a time
        at_least = [1.0, *(1 / (1 + math.exp(-(p[d].sum() - t))) for t in p[30:]), 0.0]
        want -= math.log(at_least[k] - at_least[k + 1]) / 200
    assert value == pytest.approx(want + 0.005 * (p[:30] ** 2).sum())
    for k in (0, 7, 29, 30, 31, 32):
        step = np.zeros_like(p)
        step[k] = 1e-6
        slope = (toxicity.loss(p + step, row, col, y, 3, 0.01)[0] - toxicity.loss(p - step, row, col, y, 3, 0.01)[0]) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_expected_severity(spark):
    weights = np.zeros(toxicity.FEATURES)
    weights[toxicity.feature_ids("bad")[0]], weights[toxicity.feature_ids("worse")[0]] = 1.0, 2.0
    model = toxicity.OrdinalModel(weights, np.array([0.5, 1.5, 2.5]))
    texts = ["bad", "worse bad bad", "fine", None]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, total in enumerate((1.0, 3.0, 0.0, 0.0)):
        chances = [1 / (1 + math.exp(t - total)) for t in (0.5, 1.5, 2.5)]
        assert got[k]["severity"] == pytest.approx(sum(chances), abs=1e-6) and got[k]["grade"] == sum(c > 0.5 for c in chances)


def test_spans_by_brute_force(spark):
    """Spans and what is removed, from the chunks' digests by plain dictionaries."""
    shared = [passage(1, 80), passage(2, 60)]
    rows = [(k, passage(10 + k, 30) + " " + shared[k % 2] + " " + passage(60 + k, 30)) for k in range(8)] + [(20, shared[0] + " " + shared[0]), (None, shared[1])]
    cut = {k: substring.chunks(t) for k, t in rows}
    homes = defaultdict(set)
    for k, (_, digests) in cut.items():
        for d in digests:
            homes[d].add(k)
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (starts, digests) in cut.items():
        spans, removed = [], []
        for a, b, d in zip(starts, starts[1:], digests, strict=False):
            for out, wanted in ((spans, len(homes[d]) > 1), (removed, len(homes[d]) > 1 and min(h for h in homes[d] if h is not None) != k)):
                if wanted and out and out[-1][1] == a:
                    out[-1][1] = b
                elif wanted:
                    out.append([a, b])
        long = lambda x: [s for s in x if s[1] - s[0] >= substring.MIN_WORDS]
        assert (k in got) == bool(long(spans))
        if k in got:
            assert [list(s) for s in got[k]["spans"]] == long(spans) and [list(s) for s in got[k]["removed"]] == long(removed)
