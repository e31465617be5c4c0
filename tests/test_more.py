"""Tokens, windows, embedding inputs, weak labels, reports, inline formulas."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import tokens, windows
from inkwell.functions.text import sentences
from inkwell.operators import embedding, reports, retrieval, scoring, validate, weak_labels
from inkwell.operators.symbols import clean_phrase
from inkwell.plans import tables
from inkwell.sources import html


def test_tokens():
    got = tokens.tokenize(r"Eq. (3): \omega_{c} and ω_c with H_0")
    assert {"3", "omega_c", "h_0", "omega", "c"} - {"omega"} <= set(got)
    assert tokens.tokenize("ω") == ["omega"] and tokens.tokenize("") == []


def test_queries(spark):
    df = spark.createDataFrame([("3", ["H", "a", "H"])], "id string, s array<string>")
    got = df.select(tokens.meaning_query(F.col("id"), F.col("s")).alias("m"), tokens.symbol_query(F.col("s")).alias("q"), tokens.symbol_context(F.lit("x"), F.lit("x"), F.lit("x=y"), F.lit("s")).alias("c")).first()
    assert got["m"] == "Eq 3 Equation 3 defines describes represents gives called known as H a"
    assert got["q"] == "where H is H denotes H a"
    assert got["c"] == "original LaTeX: x | canonical: x | equation: x=y | context: s"


def test_equation_windows():
    assert windows.equation_window("paper", "2.1", "a = b + c", "From Eq. ( 2.1 ) and Eq.(2.1), we obtain [EQUATION].") == "From <eqref> and <eqref>, we obtain <starteqn> a = b + c <endeqn>."
    assert windows.equation_window("paper", "4a", "x = y", "See Eq. (4b), Eqs. (4a, 4b), and Eq. ( 4a ) before [EQUATION].") == "See <other_eqref>, <other_eqref>, and <eqref> before <starteqn> x = y <endeqn>."
    for bad, n in (("No marker", 0), ("[EQUATION] and [EQUATION]", 2)):
        with pytest.raises(ValueError, match=rf"paper 'paper'.*equation '1'; found {n}"):
            windows.equation_window("paper", "1", "x", bad)


def test_entities_and_answers():
    text = "Wigner characteristic function [EQUATION]"
    tags = [("B", 0, 6), ("I", 6, 7), ("I", 7, 22), ("I", 22, 30)]
    got = windows.merge_entities(text, [{"entity": f"{t}-EQ_NAME", "start": a, "end": b} for t, a, b in tags])
    assert got == [(0, 30, "Wigner characteristic function")]
    gold = [{"paper_id": "p", "equation_id": "1", "has_answer": True, "meaning": "m"}, {"paper_id": "p", "equation_id": "2", "has_answer": False, "meaning": ""}]
    assert set(windows.answer_metrics(gold, {("p", "1"): {"meaning": "m"}}).values()) == {1.0}


def test_embedding_inputs_keep_the_budget():
    tok = embedding.WordTokenizer()
    long, short = " ".join(f"w{k}" for k in range(900)), "a b c"
    assert embedding.equation_input(tok, short) == ("equation: a b c", False)
    text, cut = embedding.equation_input(tok, long)
    assert cut and "[...]" in text and len(tok.encode(text)) <= embedding.ROOM + 1
    text, cut, lost = embedding.summary_input(tok, short, [long], [short])
    assert not cut and lost and text.startswith("before: ") and text.endswith("after: a b c") and len(tok.encode(text)) <= embedding.ROOM + 3
    text, cut, lost = embedding.sentence_input(tok, long, short, "before", 2)
    assert cut and not lost and text.endswith("distance: 2")
    assert embedding.keep_tail(tok, "a b c", 2) == (" b c", True) and embedding.keep_head(tok, "a b c", 2) == ("a b", True)


def test_pooling_and_embedding(spark):
    pooled = embedding.mean_pool(np.array([[[3.0, 0.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0]]]), np.array([[1, 0], [0, 0]]))
    assert pooled.tolist() == [[1.0, 0.0], [0.0, 0.0]]
    eqs = spark.createDataFrame([("p", "1", "x=y", [("s1", "before it")], []), ("p", "2", "x=y", [("s1", "before it")], [])], "paper_id string, equation_id string, latex string, before array<struct<sentence_id:string,text:string>>, after array<struct<sentence_id:string,text:string>>")
    made = embedding.embed(embedding.equation_inputs(eqs))
    rows = made.collect()
    assert sorted(r["vector_kind"] for r in rows) == ["before_sentence"] * 2 + ["equation"] * 2 + ["summary"] * 2
    assert all(len(r["embedding"]) == 768 and abs(np.linalg.norm(r["embedding"]) - 1) < 1e-4 for r in rows)
    assert {round(r["similarity"], 4) for r in embedding.summary_similarities(made).collect()} == {1.0}


def test_weak_labels(spark):
    assert weak_labels.weak_label("u_n_sup_L", ["u^{L}_{n}"], [], "u^{L}_{n} is the left displacement", False) == ("left", weak_labels.SUPERSCRIPT)
    assert weak_labels.weak_label("u_n", ["u_{n}"], [], "here u denotes the displacement", False) == ("displacement".join(["the ", ""]), weak_labels.BASE)
    assert weak_labels.weak_label("c", ["c"], ["c"], "the value c appears", True)[1] == weak_labels.RELATED
    assert weak_labels.weak_label("c", ["c"], ["c"], "nothing about it here", False)[1] == weak_labels.NONE
    key = "paper_id string, equation_id string, canonical string"
    syms = spark.createDataFrame([("p", "1", "u_n", ["u_{n}"], ["u_n"], "u=v"), ("p", "1", "v", ["v"], ["v"], "u=v")], f"{key}, latex_forms array<string>, aliases array<string>, latex string")
    good = spark.createDataFrame([("p", "1", "v", "the speed", "v is the speed"), ("p", "1", "v", "the  speed", "v is the speed"), ("p", "9", "v", "x", "y")], f"{key}, definition string, source_text string")
    bad = spark.createDataFrame([("p", "1", "u_n", k, f"here u denotes the thing {k}", False) for k in range(9)], f"{key}, rank int, text string, alias_mentioned boolean")
    rows = weak_labels.training_rows(syms, good, bad)
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {weak_labels.COMPLETE: 1, weak_labels.BASE: 6}
    assert [r["canonical"] for r in weak_labels.hard_negatives(rows.filter("canonical = 'v'"), syms).collect()] == ["u_n"]
    model = weak_labels.baseline_classifier(rows)
    assert model.transform(rows.withColumn("words_in", F.concat_ws(" ", "phrase", "sentence")).withColumn("weight", F.lit(1.0))).count() == 7


def test_review_and_calibration(spark):
    rows = spark.createDataFrame([("p", "1", f"s{k}", "x and y", f"a and b {k}", "NO_RELATION", k % 2 == 0) for k in range(40)], "paper_id string, equation_id string, canonical string, phrase string, sentence string, relation string, has_modifiers boolean")
    got = weak_labels.review_sample(rows, 5).collect()
    assert 5 <= len(got) <= 15 and {"NO_RELATION", "coordinated", "modifier"} == {s for r in got for s in r["review_strata"]}
    judged = spark.createDataFrame([(0.96, "A", "A")] * 12 + [(0.6, "B", "A")] * 3 + [(0.9, None, "A")], "score double, gold_relation string, predicted_relation string")
    assert judged.select(weak_labels.calibrated(judged).alias("t")).first()["t"] == 0.96
    assert weak_labels.calibrated(judged, least=50) is None


def test_reports(spark):
    rows = spark.createDataFrame([("p", "1", "where p is the momentum"), ("p", "2", "the effective Hamiltonian can be written as")], "paper_id string, equation_id string, meaning string")
    cleaned = rows.withColumn("c", clean_phrase("meaning", F.lit("source_sentence"), "meaning"))
    text = reports.postprocessing_report(cleaned)
    assert "2 records, 1 flagged, 1 changed" in text and "symbol_definition_sentence" in text
    assert reports.rejected_meanings(cleaned).first()["reasons"] == ["symbol_definition_sentence"]
    key = "paper_id string, equation_id string, canonical string"
    syms = spark.createDataFrame([("p", "1", "a"), ("p", "1", "b"), ("p", "1", "c")], key)
    left = reports.rejected_symbols(syms, syms.filter("canonical = 'a'"), syms.filter("canonical = 'b'"))
    assert {(r["canonical"], r["reason"]) for r in left.collect()} == {("b", "no_supported_definition_pattern"), ("c", "no_retrieved_alias")}
    assert "50.0" in reports.symbol_report(left)
    trail = rows.select(reports.audit_trail(F.lit("1"), F.lit(1), F.lit(2), F.array(F.lit("x")), F.lit(0), F.lit("m"), F.lit("proximity"), F.lit(0.5), F.lit(1), F.lit(0), F.lit(2)).alias("t")).first()["t"]
    assert trail["extract_context"] == "Collected 1 preceding sentence and 2 following sentences as local context."
    assert trail["build_relations"] == "Built 1 relation covering the other 1 reviewed equation; 0 non-none relations remained after scoring."


def test_inline_math(spark):
    page = '<p id="a">Let <math alttext="u^{L}_{n}" id="m1"><mi>u</mi></math> be it.</p><p>And <math alttext="u^L_n"></math> <math display="block" alttext="z"></math></p>'
    rows = html.inline_math_index(spark.createDataFrame([("p", page), ("q", None)], "paper_id string, html string")).collect()
    assert [(r["canonical"], r["occurrences"]) for r in rows] == [("u^L_n", 2)] * 2
    assert {r["paragraph"] for r in rows if r["paragraph_id"] == "a"} == {"Let $u^{L}_{n}$ be it."}


def test_sentences_keep_the_digits_at_their_ends(spark):
    rows = spark.createDataFrame([(1, "Zero 0. 19.37.233.111 is 1. 2 of 2"), (2, "a.\x0bb.\fc. d"), (3, "a\x01b"), (4, "")], "k int, t string")
    got = {r["k"]: r["s"] for r in rows.select("k", sentences(F.col("t")).alias("s")).collect()}
    assert got == {1: ["Zero 0.", "19.37.233.111 is 1.", "2 of 2"], 2: ["a.\x0bb.", "c. d"], 3: ["a", "b"], 4: []}


@pytest.mark.parametrize("name", ["sentence_split", "chunk_union"])
def test_sentence_queries_agree_with_their_sql_on_digits_and_null_texts(spark, tmp_path, name):
    rows = [(1, "One. 19.37.233.111 is 1. 2 of 2\nX. 1 and 1"), (2, None), (3, ""), (4, "a.\x0bb. \x01c")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(tables.ORACLE_SQL[name])
    got = tables.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_references_cut_off_in_a_title_stay_text():
    title = lambda h: html.parse_page(h, html.PLAIN)["title"]
    assert title("<h1>a &amp;&amp <b>&lt;x&gt; &#65; &#x42; R&D &copy 1</b></h1><h1>c</h1>") == "a &&amp <x> A B R&D &copy 1"
    assert title("<h1>cut &am") == "cut &am"


def _random_search(spark, n=300):
    rng = np.random.default_rng(4)
    word = lambda k: [str(w) for w in rng.zipf(1.4, k) % 40]
    docs = [(int(d), str(d % 3), word(int(rng.integers(0, 30)))) for d in rng.permutation(n)] + [(n, "0", []), (n + 1, "1", None)]
    docs += [(n + 2 + k, "1", docs[k][2]) for k in range(60)]
    return spark.createDataFrame(docs, "doc_id int, lang string, tokens array<string>").repartition(5), spark.createDataFrame([(q, word(6)) for q in "abcd"] + [("none", ["unknown"])], "qid string, tokens array<string>")


def test_best_documents_by_bm25_are_those_of_all_scores_and_only_they_are_shuffled(spark):
    docs, asked = _random_search(spark)
    got = retrieval.bm25_top(docs, asked, 7, F.col("lang") != "0")
    want = retrieval.top_k(retrieval.bm25(docs, asked).join(docs.filter("lang <> '0'"), "doc_id", "left_semi"), 7)
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "rank", "score").collect())
    assert rows(got) == rows(want) and len(rows(got)) == 28
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    many = scoring.MOST_TERMS
    try:
        scoring.MOST_TERMS = 1
        assert rows(retrieval.bm25_top(docs, asked, 7, F.col("lang") != "0")) == rows(want)
    finally:
        scoring.MOST_TERMS = many


def test_rounding_is_sparks(spark):
    x = np.concatenate([np.random.default_rng(1).uniform(0, 30, 500), (np.arange(500) * 2 + 1) / 2e6, [1.0000005, 2.5e-7, 5e-7, 1234.5678905]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert scoring.rounded(x).tolist() == got


def test_coverage_of_all_pairs_is_that_of_the_pairs_in_rows(spark):
    equations = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "3"), ("p", "3"), ("p", None), (None, "1"), ("q", "1"), ("r", "1"), ("r", "2")], "paper_id string, equation_id string")
    told = [("p", "1", "2"), ("p", "1", "2"), ("p", "1", "3"), ("p", "2", "2"), ("p", "2", "9"), ("p", "7", "1"), ("p", None, "1"), ("p", "1", None), (None, "1", "2"), ("s", "1", "2"), ("r", "1", "2"), ("r", "2", "1")]
    relations = spark.createDataFrame(told, "paper_id string, src string, dst string")
    grid = equations.withColumnRenamed("equation_id", "src").join(equations.withColumnRenamed("equation_id", "dst"), "paper_id").filter("src <> dst")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    got = validate.grid_coverage(equations, relations)
    assert rows(got) == rows(validate.coverage(grid, relations, ["paper_id", "src", "dst"])) and len(rows(got)) == 11
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_documents_are_counted_without_a_shuffle(spark):
    docs, _ = _random_search(spark)
    got = scoring.counted(docs)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
