"""Section ids and order, the equation resolver, evidence, symbol meanings, vectors, fetching, windows."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import evidence, tokens
from inkwell.functions import windows as plain_windows
from inkwell.operators import chunks, context, embedding, export, meanings, ordering, reports, resolve, selection, structure, symbol_meanings, validate, vectors, windows
from inkwell.plans import search
from inkwell.sources import fetch, readers, sinks


def test_unused_ids_avoid_ids_that_others_bring(spark):
    rows = spark.createDataFrame([("p", k, b) for k, b in enumerate(["a", "a", "a:2", "a", "b", "a:2"])], "paper_id string, at int, base string")
    got = {r["at"]: r["section_id"] for r in structure.unused_ids(rows, ["paper_id"], "at", "base", "section_id").collect()}
    used, want = [], {}
    for k, b in enumerate(["a", "a", "a:2", "a", "b", "a:2"]):  # one by one, the first suffix that is free
        name, n = b, 2
        while name in used:
            name, n = f"{b}:{n}", n + 1
        used.append(name)
        want[k] = name
    assert got == want
    counted = {r["at"]: r["id"] for r in structure.numbered_ids(rows, ["paper_id"], "at", "base", "id").collect()}
    assert counted == {0: "a", 1: "a:2", 2: "a:2", 3: "a:3", 4: "b", 5: "a:2:2"}


def test_sections(spark):
    sections = spark.createDataFrame([("p", "b", 5), ("p", "a", 5), ("p", "z", None), ("p", "c", 1)], "paper_id string, section_id string, position int")
    assert [r["section_id"] for r in structure.ordered_sections(sections).orderBy("order").collect()] == ["z", "c", "a", "b"]
    paragraphs = spark.createDataFrame([("p", None, 9, True), ("p", None, 4, True), ("p", None, 2, False), ("p", "s", 1, False)], "paper_id string, section_id string, document_order int, in_abstract boolean")
    got = {r["section_id"]: (r["title"], r["level"], r["position"]) for r in structure.synthetic_sections(paragraphs).collect()}
    assert got == {"__abstract__": ("Abstract", 0, 4), "__main__": ("Main matter", 1, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_parents_at_any_depth(spark, seed):
    r = np.random.default_rng(seed)
    levels = r.integers(0, 12, 40).tolist()
    rows = spark.createDataFrame([("p", k, v) for k, v in enumerate(levels)], "paper_id string, at int, level int").withColumn("id", F.concat(F.lit("s"), "at"))
    got = {x["at"]: x["parent"] for x in context.parents_by_level(rows, ["paper_id"], "at", "level", "id").collect()}
    assert got == {k: next((f"s{j}" for j in range(k - 1, -1, -1) if levels[j] < v), None) for k, v in enumerate(levels)}


def test_running_totals(spark):
    rows = [(k * 7 % 101, k % 5) for k in range(101)]
    got = {r["k"]: (r["n"], r["s"]) for r in ordering.running_totals(spark.createDataFrame(rows, "k int, v int"), [F.col("k")], n=F.lit(1), s=F.col("v")).collect()}
    total, want = 0, {}
    for at, (k, v) in enumerate(sorted(rows)):
        want[k] = at, total
        total += v
    assert got == want


TABLES = [
    ("p", "T1", 1, ["T1", "m1"], ["1"], ["x=y"]), ("p", "T2", 2, ["T2", "m2"], ["2"], ["a=b"]), ("p", "T3", 3, ["T3", "m1"], ["2"], ["c=d"]),
    ("p", "T4", 4, ["T4"], ["4"], ["e=f", "g"]), ("p", "T5", 5, ["T5"], ["5", "6"], ["e=f"]), ("q", "U1", 1, ["T1"], ["1"], ["x=y"]),
]


def test_resolver(spark):
    tables = spark.createDataFrame(TABLES, "paper_id string, table_id string, document_order int, dom_ids array<string>, labels array<string>, forms array<string>")
    entries = [
        ("p", "9", "zzz", ["none", "m2"], "T1", ("T2", "annotation_id")), ("p", "8", "x=y", ["m1"], None, ("T1", "annotation_id")), ("p", "7", "a=b", [], "T4", ("T4", "audit_anchor_id")),
        ("p", "1", "c=d", [], "gone", ("T1", "visible_label")), ("p", "2", "c = d", [], None, ("T3", "visible_label_and_latex")), ("p", "3", "g", [], None, ("T4", "exact_latex")),
        ("p", "10", "e=f", [], None, (None, "unresolved")), ("p", "11", "", [], None, (None, "unresolved")), ("q", "5", "x=y", ["m2"], None, ("U1", "exact_latex")),
    ]
    got = resolve.resolve(spark.createDataFrame([e[:5] for e in entries], "paper_id string, equation_id string, equation string, annotation_ids array<string>, audit_anchor_id string"), tables)
    assert {(r["paper_id"], r["equation_id"]): (r["table_id"], r["match_method"]) for r in got.collect()} == {e[:2]: e[5] for e in entries}


def test_resolver_at_equal_places(spark):
    tables = [("p", 9, 1, ["a"], [], []), ("p", 3, 1, ["a", "b"], [], []), ("p", 7, 1, ["a", "b"], [], []), ("p", 1, 2, ["a", "b"], [], []), ("p", 2, None, ["a", "c"], [], []), ("p", 4, 1, [], ["n"], ["x"])]
    entries = [("p", "8", "", ["c", "a"], None, (3, "annotation_id")), ("p", "9", "", [], "b", (3, "audit_anchor_id")), ("p", "10", "", ["c"], None, (None, "unresolved")), ("p", None, "x", [], None, (4, "exact_latex"))]
    asked = spark.createDataFrame([e[:5] for e in entries], "paper_id string, equation_id string, equation string, annotation_ids array<string>, audit_anchor_id string")
    for rows in (tables, tables[::-1]):
        got = resolve.resolve(asked, spark.createDataFrame(rows, "paper_id string, table_id int, document_order int, dom_ids array<string>, labels array<string>, forms array<string>").coalesce(1))
        assert {(r["paper_id"], r["equation_id"]): (r["table_id"], r["match_method"]) for r in got.collect()} == {e[:2]: e[5] for e in entries}


@pytest.mark.parametrize("odd", ["p_size = 7", "p_size = CASE WHEN p_partkey % 3 > 0 THEN p_size END", "p_brand = CASE WHEN p_partkey % 3 > 0 THEN p_brand END", "p_type = CASE WHEN p_partkey % 4 > 0 THEN p_type END"])
def test_resolver_query_on_odd_parts(spark, tmp_path, odd):
    con = duckdb.connect(config={"threads": 1})  # of equal places DuckDB then takes the first row, of the smallest id here
    con.sql("""CREATE TABLE part AS SELECT i AS p_partkey, 'Brand#' || hash(i) % 7 AS p_brand, 'TYPE ' || hash(-i) % 5 AS p_type, (hash(i + 1000) % 9)::INT AS p_size FROM range(600) r(i)""")
    con.sql("CREATE TABLE customer AS SELECT i AS c_custkey FROM range(1500) r(i)")
    con.sql(f"UPDATE part SET {odd}")
    for name, by in (("part", "p_partkey"), ("customer", "c_custkey")):
        con.sql(f"COPY (SELECT * FROM {name} ORDER BY {by}) TO '{tmp_path}/{name}.parquet'")
        con.sql(f"DROP TABLE {name}; CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = search.equation_resolver(spark, str(tmp_path))
    want = con.sql(search.ORACLE_SQL["equation_resolver"])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_annotations_and_audits(spark):
    rows = spark.createDataFrame([(['<math><annotation encoding="x" id="a.1">t</annotation></math>', "<p>none</p>", "<annotation id='a.1'></annotation><annotation id='b'></annotation>", "<annotation></annotation><annotation id='c'>"],), (None,)], "h array<string>")
    assert [r[0] for r in rows.select(resolve.annotation_ids(F.col("h"))).collect()] == [["a.1"], []]
    trail = spark.createDataFrame([([("one", None), ("two", ("x", None)), ("three", ("y", "z")), ("four", None)],)], "t array<struct<step:string,context_extraction:struct<anchor_id:string,matched_annotation_id:string>>>")
    assert trail.select(resolve.context_audit(F.col("t"))["anchor_id"]).first()[0] == "y"


def test_references(spark):
    equations = spark.createDataFrame([("p", "1"), ("p", "2")], "paper_id string, equation_id string")
    references = spark.createDataFrame([("p", "r1", ["2", "7", "2", "1", "7"]), ("q", "r2", ["1"])], "paper_id string, reference_id string, targets array<string>")
    got = {r["reference_id"]: (r["resolved"], r["unresolved"]) for r in structure.split_labels(references, equations).collect()}
    assert got == {"r1": (["2", "1"], ["7"]), "r2": ([], ["1"])}
    attached = spark.createDataFrame([("p", "r1"), ("p", "r1"), ("q", "r2")], "paper_id string, reference_id string")
    assert [(r["entity"], r["error"]) for r in structure.attachment_errors(references, attached).collect()] == [("r2", "not attached 2 times")]
    totals = structure.paper_totals(spark.createDataFrame([("p",), ("q",), ("z",)], "paper_id string"), equations=equations, references=references)
    assert sorted(map(tuple, totals.collect())) == [("p", 2, 1), ("q", 0, 1), ("z", 0, 0)]
    assert tuple(structure.overall_totals(totals).first()) == (3, 2, 2)
    grouped = export.grouped_reasons(spark.createDataFrame([("b", "ok"), ("a", "ok"), ("c", "failed")], "paper_id string, status string"))
    assert {r["status"]: (r["n"], r["papers"]) for r in grouped.collect()} == {"ok": (2, ["a", "b"]), "failed": (1, ["c"])}


def test_evidence_of_equations(spark):
    equations = spark.createDataFrame([("p", "1", 1, "a", "b"), ("p", "2", 3, "b", "c"), ("p", "3", 4, "c", "c")], "paper_id string, equation_id string, document_order int, previous_paragraph_id string, next_paragraph_id string")
    sentences = spark.createDataFrame([("p", x, f"{x}{k}", "s", f"text {x}{k}", k) for x in "abc" for k in (1, 2)], "paper_id string, paragraph_id string, sentence_id string, section_id string, text string, order int")
    got = {(r["equation_id"], r["sentence_id"]): (r["position"], r["pos"]) for r in structure.equation_evidence(equations, sentences).collect()}
    assert got[("1", "a1")] == ("before_equation", 0) and got[("1", "b2")] == ("introduces_other_equation", 3)
    assert got[("2", "b1")] == ("before_equation", 0) and got[("2", "c1")] == ("introduces_other_equation", 2)
    assert got[("3", "c1")] == ("after_equation", 0) and got[("3", "c2")] == ("after_equation", 1) and len(got) == 10


def test_records_and_markup(spark):
    equations = spark.createDataFrame([("p", "1", "r1", ["a", "z", "b", "c", "d", "e"], []), ("p", "2", "r9", ["c"], ["a"])], "paper_id string, equation_id string, raw_equation_id string, before_sentence_ids array<string>, after_sentence_ids array<string>")
    sentences = spark.createDataFrame([("p", x, x.upper()) for x in "abcde"], "paper_id string, sentence_id string, text string")
    got = {r["equation_id"]: r for r in structure.equation_records(equations, sentences).collect()}
    assert [tuple(s) for s in got["1"]["before_sentences"]] == [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")] and got["1"]["after_sentences"] == []
    assert [tuple(s) for s in got["2"]["after_sentences"]] == [("a", "A")]
    raw = spark.createDataFrame([("p", "r1", ["<math>"])], "paper_id string, raw_equation_id string, mathml array<string>")
    assert {r["equation_id"]: r["mathml"] for r in structure.with_markup(equations, raw).collect()} == {"1": ["<math>"], "2": []}


def test_representations_and_audits(spark):
    row = spark.createDataFrame([("x=y", [], ["a", "b", "a"], ["S", "", "S", "T"])], "e string, s array<string>, c array<string>, t array<string>")
    assert row.select(tokens.equation_representation(*map(F.col, "esct"))).first()[0] == "mathematical equation: x=y | symbols: a b | section: S; T"
    none = F.array().cast("array<string>")
    assert row.select(tokens.equation_representation(F.col("e"), none, none, none)).first()[0] == "mathematical equation: x=y"
    say = lambda method: row.select(reports.audit_trail(F.lit("1"), F.lit(0), F.lit(0), none, F.lit(0), F.lit(""), F.lit("none"), F.lit(0.0), F.lit(0), F.lit(0), F.lit(1), method).alias("t")).first()["t"]
    assert say(F.lit("exact_latex"))["extract_eq"] == "Found numbered equation (1) in the source text using exact_latex."
    assert say(F.lit(None).cast("string"))["extract_eq"] == "Found reviewed equation (1) in the annotation data."
    lost = say(F.lit("unresolved"))
    assert lost["extract_eq"].endswith("could not align it to a raw HTML equation.") and lost["extract_context"].endswith("was unresolved.")


def result(rank, text, kind="sentence", score=1.0, near=()):
    return {"rank": rank, "score": score, "chunk_id": f"c{rank}", "chunk_type": kind, "text": text, "nearby_equation_ids": list(near)}


def test_evidence_sentences():
    found = evidence.evidence([result(1, "Section: x", "paragraph"), result(2, "One  two three. Four five.", "paragraph", 0.5), result(3, "one two three.", "sentence", 0.1), result(4, "Four five.", "paragraph", 0.7)])
    assert [(t, r["rank"]) for t, r in found] == [("one two three.", 3), ("Four five.", 4)]


@pytest.mark.parametrize(
    ("text", "phrase", "source"),
    [
        ("Here H denotes the total energy of the system.", "total energy of the system", "cue_tail"),
        ("let H be the total energy of the system.", "total energy of the system", "let_be"),
        ("We write the total energy as H.", "total energy", "reverse_definition"),
        ("the state vector and the total energy as H.", "total energy", "coordinated_right"),
        ("for the total energy H we find", "total energy", "noun_before_symbol"),
        ("with H, the total energy, we find", "total energy", "appositive"),
    ],
)
def test_phrases_around_a_symbol(text, phrase, source):
    assert (phrase, source) in evidence.phrases_in(text, ("H",))
    assert all(p in text for p, _ in evidence.phrases_in(text, ("H",)))
    assert evidence.phrases_in(text, ()) == []


def test_symbol_meanings_by_cue(spark):
    symbols = spark.createDataFrame([("p", "1", "H", ["H"], False), ("p", "1", "k", ["k"], False), ("p", "2", "H", ["H"], False)], "paper_id string, equation_id string, canonical string, aliases array<string>, has_modifiers boolean")
    told = [("p", "1", "H", result(1, "where H is the total energy. Another line.", "paragraph", 2.0, ["1"])), ("p", "1", "H", result(2, "H denotes the kinetic energy.", "sentence", 1.0)), ("p", "1", "k", result(1, "nothing here"))]
    rows = [(*k, *[r[c] for c in ("rank", "score", "chunk_id", "chunk_type", "text", "nearby_equation_ids")]) for *k, r in told]
    results = spark.createDataFrame(rows, "paper_id string, equation_id string, canonical string, rank int, score double, chunk_id string, chunk_type string, text string, nearby_equation_ids array<string>")
    for generation in (1, 2):
        got = {(r["equation_id"], r["canonical"]): r for r in symbol_meanings.symbol_meanings(symbols, results, generation).collect()}
        assert got["1", "H"]["definition"] == "total energy" and got["1", "H"]["candidate_score"] == 9.0 and got["1", "H"]["confidence"] == 0.8182
        assert json.loads(got["1", "H"]["features"]) == {"alias_definition_pattern": 4.0, "definition_cue": 2.0, "near_target_equation": 2.0, "retrieval_score": 1.0}
        assert got["1", "k"]["rejection_reason"] == "no_retrieved_alias" and got["2", "H"]["definition"] == "" and len(got) == 3
    with pytest.raises(ValueError):
        symbol_meanings.symbol_meanings(symbols, results, 3)


def test_symbol_meaning_by_classifier():
    symbol = {"equation_id": "1", "aliases": ["H"], "has_modifiers": True}
    results = [result(k, f"for the energy number{k} H we find") for k in range(1, 60)]
    seen = []

    def classify(label):
        def run(s, candidates):
            seen.append(len(candidates))
            return [{label: 0.999 if c["result"]["rank"] == 3 else 0.5, "NONE": 0.001} for c in candidates]

        return run

    assert symbol_meanings.meaning_of(symbol, results)["rejection_reason"] == "no_supported_definition_pattern"
    done = symbol_meanings.meaning_of(symbol, results, classifier=classify("DEFINES_COMPLETE_SYMBOL"))
    assert done["definition"] == "energy number3" and done["source_chunk_id"] == "c3" and seen[-1] == 48
    assert symbol_meanings.meaning_of(symbol, results, classifier=classify("DEFINES_BASE"))["rejection_reason"] == "below_relation_threshold"
    plain = symbol | {"has_modifiers": False}
    assert symbol_meanings.meaning_of(plain, results, classifier=classify("DEFINES_BASE"))["definition"] == "energy number3"
    assert symbol_meanings.meaning_of(plain, results, classifier=classify("DEFINES_BASE"), gate={"acceptance_enabled": False})["rejection_reason"] == "reviewed_precision_gate_not_satisfied"
    with pytest.raises(ValueError):
        symbol_meanings.meaning_of(symbol, results, classifier=lambda s, c: [])


def test_dependency_parser_helps_out():
    symbol = {"equation_id": "1", "aliases": ["H"]}
    results = [result(1, "Energy, H, total energy of all", near=["1"])]
    assert symbol_meanings.meaning_of(symbol, results, 1)["definition"] == ""
    done = symbol_meanings.meaning_of(symbol, results, 1, dependency=lambda t, a: ("total energy", "H"))
    assert done["strategy"] == "spacy_dependency" and done["candidate_score"] == 10.0


def test_first_chunks(spark):
    sections = spark.createDataFrame([("p", "s1", "Model"), ("p", "s2", None)], "paper_id string, section_id string, title string")
    paragraphs = spark.createDataFrame([("p", "a", "s1", "Before."), ("p", "b", "s1", "After."), ("p", "c", "s2", "Loose.")], "paper_id string, paragraph_id string, section_id string, text string")
    equations = spark.createDataFrame([("p", "1", "x=y", "s1", "a", "b"), ("p", "2", "z", "s2", "b", None)], "paper_id string, equation_id string, latex string, section_id string, previous_paragraph_id string, next_paragraph_id string")
    got = {r["chunk_id"]: r for r in chunks.build_first_chunks(sections, paragraphs, equations).collect()}
    assert got["p:section_aware:a"]["text"] == "Section: Model\nBefore." and got["p:section_aware:c"]["text"] == "Loose."
    assert got["p:section_aware:b"]["nearby_equation_ids"] == ["1", "2"] and got["p:section_aware:c"]["nearby_equation_ids"] == []
    assert got["p:equation_neighborhood:1"]["text"] == "Section: Model\nBefore.\nEquation (1): x=y\nAfter."
    assert got["p:equation_neighborhood:1"]["nearby_equation_ids"] == ["1", "2"] and got["p:equation_neighborhood:1"]["paragraph_ids"] == ["a", "b"]
    assert got["p:equation_neighborhood:2"]["text"] == "After.\nEquation (2): z"


def test_batch_search_and_first_meanings(spark):
    rows = [("c1", "p", "sentence", "Equation 3 defines the total Hamiltonian of the system.", "S", ["3"]), ("c2", "p", "sentence", "Hamiltonian of another equation", "S", ["4"]), ("c3", "p", "raw_equation", "Hamiltonian", "S", ["3"])]
    held = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_type string, text string, section_id string, nearby_equation_ids array<string>").withColumns({"symbols": F.array().cast("array<string>"), "tokens": F.split(F.lower("text"), r"\W+")})
    asked = spark.createDataFrame([("p", "3", "hamiltonian equation"), ("p", "9", "hamiltonian")], "paper_id string, equation_id string, text string").withColumn("tokens", F.split("text", " "))
    found = meanings.batch_search(held, asked).withColumns({"equation_id": F.split("qid", "/")[1]})
    assert [(r["equation_id"], r["chunk_id"]) for r in found.collect()] == [("3", "c1")]
    got = {r["equation_id"]: r for r in meanings.first_meanings(asked, found.select("paper_id", "equation_id", "rank", "score", "chunk_id", "text", "nearby_equation_ids")).collect()}
    assert got["3"]["meaning"] == "the total Hamiltonian of the system" and got["3"]["selection"] == "combined_score"
    assert got["9"]["meaning"] == "" and got["9"]["strategy"] == "no_reliable_candidate"


def test_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    held = r.normal(size=(700, 8))
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(k, int(k % 3), v.tolist()) for k, v in enumerate(held)], "vec_id long, label int, embedding array<double>").repartition(3)
    asked = corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    scores = (held @ held.T).round(6)
    got, by = {}, {}
    for x in vectors.cosine_top_k(corpus, asked, 5).collect():
        got.setdefault(x["qid"], []).append((x["rank"], x["vec_id"]))
    for x in vectors.cosine_top_k(corpus, asked, 2, by="label").collect():
        by.setdefault((x["qid"], x["label"]), []).append((x["rank"], x["vec_id"]))
    for q in range(0, 700, 20):
        ranked = sorted((k for k in range(700) if k != q), key=lambda k: (-scores[q, k], k))
        assert [v for _, v in sorted(got[q])] == ranked[:5]
        for label in range(3):
            assert [v for _, v in sorted(by[q, label])] == [k for k in ranked if k % 3 == label][:2]
    assert vectors.cosine_top_k(corpus.limit(0), asked, 5).count() == 0 == vectors.cosine_top_k(corpus, asked.limit(0), 5).count()

    schema = "paper_id string, vector_kind string, sentence_id string, chunk_id string, embedding array<float>"
    space = spark.createDataFrame([("p", "sentence", "s1", None, [1.0, 0.0]), ("p", "sentence_chunk", None, "c1", [0.0, 1.0])], schema)
    asked = spark.createDataFrame([("p", "s1", "c1"), ("p", "s9", "c1"), ("p", "s9", "c9"), ("p", None, "c1")], "paper_id string, sentence_id string, chunk_id string")
    found = {(x["sentence_id"], x["chunk_id"]): x["embedding"] for x in vectors.candidate_vectors(asked, space).collect()}
    assert found == {("s1", "c1"): [1.0, 0.0], ("s9", "c1"): [0.0, 1.0], ("s9", "c9"): None, (None, "c1"): [0.0, 1.0]}
    texts = vectors.chunk_texts(spark.createDataFrame([("c1", None, "own"), ("c2", "s2", "own"), ("c9", "", "own")], "chunk_id string, sentence_id string, source_text string"), spark.createDataFrame([("c1", "told", "s1"), ("c2", "", None)], "chunk_id string, text string, sentence_id string"))
    assert {x["chunk_id"]: (x["text"], x["sentence_id"]) for x in texts.collect()} == {"c1": ("told", "s1"), "c2": ("own", "s2"), "c9": ("own", "c9")}
    sinks.write_vectors(space, str(tmp_path / "v"), "none")
    assert spark.read.json(str(tmp_path / "v/metadata")).first()["dimension"] == 2 and readers.vector_table(spark, str(tmp_path / "v/vectors"), 2).count() == 2
    told = spark.createDataFrame([("p", "sentence", "c1", "s1", " one two "), ("p", "paragraph", "c2", None, "no"), ("p", "sentence", "c3", "s3", "  ")], "paper_id string, chunk_type string, chunk_id string, sentence_id string, text string")
    assert [(x["chunk_id"], x["source_text"]) for x in embedding.chunk_inputs(told).collect()] == [("c1", "one two")]


def test_fetching(spark):
    waits, replies = [], {"a": [fetch.Reply(429, headers={"Retry-After": "900"}), fetch.Reply(200, "<a>")], "b": [fetch.Reply(404)], "c": [fetch.Reply(500)] * 9, "d": [fetch.Reply(403)]}
    get = lambda p: replies[p].pop(0)
    assert [fetch.fetch_one(p, get, waits.append) for p in "abcd"] == [("ok", "<a>"), ("not_found", None), ("http_500", None), ("http_403", None)]
    assert waits == [60.0, 1.0, 2.0]

    def broken(p):
        raise OSError(p)

    assert fetch.fetch_one("x", broken, waits.append) == ("failed", None) and len(replies["c"]) == 6
    papers = spark.createDataFrame([("a",), ("b",), ("a",)], "paper_id string")
    got = fetch.fetch_pages(papers, lambda: lambda p: fetch.Reply(200, f"<{p}>"), spark.createDataFrame([("b", "old")], "paper_id string, html string"))
    assert sorted(map(tuple, got.collect())) == [("a", "ok", "<a>"), ("b", "cached", "old")]


def test_windows_agree_with_the_plain_form(spark):
    told = ["By Eq. (1) and Eq. (2), Eqs. (1) and (2), [EQUATION] holds; see equation ( 1 ) and Equations (3, 4).", "[EQUATION]"]
    rows = spark.createDataFrame([("p", "1", "x=y\\2$1", t) for t in told], "paper_id string, equation_id string, equation string, window string")
    got = {r["window"]: r["told"] for r in windows.equation_windows(rows).collect()}
    assert got == {t: plain_windows.equation_window("p", "1", "x=y\\2$1", t) for t in told}
    with pytest.raises(validate.ValidationError):
        windows.equation_windows(rows.withColumn("window", F.lit("none")))
    text = "the  master equation is the Bloch equation"
    tags = [("B-EQ_NAME", 5, 11), ("I-EQ_NAME", 12, 20), ("O", 21, 23), ("I-EQ_NAME", 28, 33), ("B-EQ_NAME", 34, 42)]
    spans = windows.entity_spans(spark.createDataFrame([(1, a, b, e) for e, a, b in tags], "text_id int, start int, end int, entity string"), spark.createDataFrame([(1, text)], "text_id int, text string"))
    assert sorted((r["start"], r["end"], r["span"]) for r in spans.collect()) == plain_windows.merge_entities(text, [{"entity": e, "start": a, "end": b} for e, a, b in tags])
    gold = [("p", "1", "a", True), ("p", "2", "", False), ("p", "3", "b", True), ("p", "4", "", False)]
    said = [("p", "1", "a"), ("p", "2", "x"), ("p", "3", "c")]
    got = windows.answer_metrics(spark.createDataFrame(gold, "paper_id string, equation_id string, meaning string, has_answer boolean"), spark.createDataFrame(said, "paper_id string, equation_id string, meaning string")).first().asDict()
    plain = plain_windows.answer_metrics([dict(zip(("paper_id", "equation_id", "meaning", "has_answer"), g, strict=True)) for g in gold], {s[:2]: {"meaning": s[2]} for s in said})
    assert got == {k: round(v, 6) for k, v in plain.items()}


def test_subsets_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "paper_id string, n int")
    wanted = spark.createDataFrame([("q",)], "paper_id string")
    assert [r["n"] for r in readers.paper_subset(rows, wanted).collect()] == [2]
    with pytest.raises(validate.ValidationError, match="unknown paper"):
        readers.paper_subset(rows, wanted.union(spark.createDataFrame([("z",)], "paper_id string")))
    sinks.write_review_sample(rows, str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "review")).filter("gold_relation = ''").count() == 2
    with pytest.raises(validate.ValidationError):
        sinks.write_review_sample(rows.withColumn("paper_id", F.lit("../x")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        sinks.write_postprocessed(rows, str(tmp_path / "a"), str(tmp_path / "a/"))


def test_split_labels_brings_no_set_of_a_papers_equations_to_its_references(spark):
    rows = [(1, ["7", "x", "7", None, "2"]), (1, ["7", "x", "7", None, "2"]), (1, []), (1, None), (2, ["7"]), (None, ["7"])]
    references = spark.createDataFrame(rows, "paper_id long, targets array<string>")
    equations = spark.createDataFrame([(1, "2"), (1, "7"), (1, "7"), (1, None), (None, "7")], "paper_id long, equation_id string")
    found = structure.split_labels(references, equations)
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((tuple(r) for r in found.select("paper_id", "targets", "resolved", "unresolved").collect()), key=str)
    both = (1, ["7", "x", "7", None, "2"], ["7", "2"], ["x", None])
    assert got == sorted([both, both, (1, [], [], []), (1, None, None, None), (2, ["7"], [], ["7"]), (None, ["7"], [], ["7"])], key=str)


def test_priority_cascade_makes_one_row_of_the_candidates_of_a_key(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (3, "c", None), (4, "d", 2), (4, "e", 2)], "k long, name string, n long")
    named = spark.createDataFrame([(10, "a"), (11, "c"), (12, "c"), (10, "a")], "target long, name string")
    numbered = spark.createDataFrame([(7, 2), (7, 2), (8, 9), (9, None)] + [(n, 1) for n in range(500)], "target long, n long")
    equal = [("name", named, [(F.col("name"), "name")]), ("number", numbered, [(F.col("n"), "n")])]
    got = selection.priority_cascade(left, "k", equal, "target")
    rows = sorted((r["k"], r["target"], r["match_method"]) for r in got.select("k", "target", "match_method").fillna(-1).collect())
    assert rows == [(1, 10, "name"), (2, 8, "number"), (3, -1, "unresolved"), (4, 7, "number"), (4, 7, "number")]
    plan = search.priority_cascade(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and plan.count("Aggregate [") >= 4
