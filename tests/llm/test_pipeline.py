"""The pipeline against the same stages in plain Python, on a fixture with planted cases."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as cp
from inkwell.llm import secret_scan, simhash, substring
from tests.llm.test_operators import brute_print, brute_quality, passage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    shared, near = passage(1, 70), passage(7, 300).split()
    texts = [passage(100 + k, 60) for k in range(6)] + [passage(200 + k, 40) + " " + shared + " " + passage(300 + k, 40) for k in range(3)]
    texts += [" ".join(near), " ".join([*near[:-1], "zzz"]), texts[0], "too short", "spam " * 100, None, passage(400, 40) + " token = \"abcdef0123456789abcdef\" " + passage(401, 20), passage(500, 2000)]
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[2])
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"] for r in cp.quality_stage(spark, docs, path).collect()}
    want = {r[0] for r in rows if not ((n := brute_quality(r[1]))[0] < 20 or 100 * n[4] > 30 * n[0])}
    assert kept == want and {12, 13, 14}.isdisjoint(kept)
    left = cp.quality_stage(spark, docs, path)
    once = cp.near_dup_stage(spark, left, path)
    ids = sorted(r["doc_id"] for r in once.collect())
    texts = {r[0]: r[1] for r in rows}
    chosen = []
    for i in sorted(want):
        if not any((brute_print(texts[i]) ^ brute_print(texts[j])).bit_count() <= 3 for j in chosen):
            chosen.append(i)
    assert ids == chosen and 11 not in ids and ids.count(2) == 1
    cut = cp.substring_stage(spark, once, path)
    assert cut.columns == once.columns == docs.columns == COLUMNS
    after = {r["doc_id"]: r for r in cut.collect()}
    assert after[6]["text"] == texts[6] and len(after[7]["text"]) < len(texts[7]) and after[0]["text"] == texts[0]
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    safe = {r["doc_id"]: r["text"] for r in cp.secrets_stage(spark, cut, path).collect()}
    assert "<assign>" in safe[15] and "abcdef0123456789" not in safe[15]
    assert {i: t for i, t in safe.items() if i != 15} == {i: r["text"] for i, r in after.items() if i != 15}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    from inkwell.llm.bpe import vocabulary_path

    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, path)
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got: dict[int, int] = {}
    rooms: dict[int, int] = {}
    for r in cp.run(spark, path).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        rooms[r["sequence_id"]] = rooms.get(r["sequence_id"], 0) + r["length"]
    assert got == want and max(rooms.values()) <= 1024


def test_empty(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_kernels_are_imported():
    assert np.uint64(simhash.fingerprint("a b c")) and substring.MIN_WORDS == 20 and secret_scan.redact(None) is None
