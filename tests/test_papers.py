"""A paper from HTML to the final object, and the checks on the way."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import context, export, meanings, relations, retrieval, selection, symbols, validate
from inkwell.plans import papers
from inkwell.sources import html, readers, sinks

EQ = '<table class="ltx_equation" id="S1.E{n}"><tr><td><math alttext="{tex}">{ml}<annotation encoding="application/x-tex">{tex}</annotation></math></td><td class="ltx_eqn_eqno">({n})</td></tr></table>'
PAGE = f"""<html><head><title>t</title></head><body><h1 class="ltx_title ltx_title_document">A Structured Paper</h1>
<div class="ltx_abstract"><p class="ltx_p">We study a model. {"It is long enough to be valid. " * 12}</p></div>
<section class="ltx_section"><h2>Model</h2><p class="ltx_p">Here <math alttext="\\omega">x</math> denotes the angular frequency of the mode. The effective Hamiltonian is given by</p>
{EQ.format(n=1, tex="H=x", ml="<mi>H</mi><mo>=</mo><mi>x</mi>")}
<p class="ltx_p">The energy follows from Eq. (1). See Eqs. (1, 2).</p>
{EQ.format(n=2, tex="E=x", ml="<mi>E</mi><mo>=</mo><mi>x</mi>")}
<section class="ltx_subsection"><h3>Sub</h3><figure><p class="ltx_p">Not this one.</p></figure><p class="ltx_p">Deep text here, where H is the total system Hamiltonian.</p></section></section>
<section class="ltx_bibliography"><p class="ltx_p">No reference.</p></section></body></html>"""


@pytest.fixture(scope="module")
def run(spark):
    pages = spark.createDataFrame([("p1", PAGE), ("short", "<body></body>")], "paper_id string, html string")
    return papers.analyse(pages)


def test_structure(run):
    row = run["parsed"].first()
    assert row["title"] == "A Structured Paper"
    assert [(s["section_id"], s["parent_section_id"]) for s in row["sections"]] == [("sec:preamble", None), ("sec:section:1", None), ("sec:subsection:1", "sec:section:1")]
    texts = [p["text"] for p in row["paragraphs"]]
    assert any("\\omega denotes" in t for t in texts) and not any("Not this" in t or "No reference" in t for t in texts)
    assert [e["visible_labels"] for e in row["equations"]] == [["1"], ["2"]]
    errors = validate.document_errors(html.sections(run["parsed"]), html.paragraphs(run["parsed"]), html.sentences(run["parsed"]), html.cross_references(html.sentences(run["parsed"])))
    validate.require(errors)


def test_chunks(run):
    kinds = {r["chunk_type"]: r["count"] for r in run["chunks"].groupBy("chunk_type").count().collect()}
    assert kinds["raw_equation"] == 2 and kinds["raw_equation_neighborhood"] == 2 and kinds["section_context"] == 3 and kinds["cross_reference"] == 2
    around = run["chunks"].filter("chunk_id = 'p1:raw_equation_neighborhood:raw:0001'").first()
    assert "[EQUATION: H=x]" in around["text"] and around["section_title"] == "Model"
    assert run["chunks"].select("chunk_id").distinct().count() == run["chunks"].count()


def test_contexts(run):
    eq = run["equations"].orderBy("ordinal").first()
    assert len(eq["before"]) == 5 and eq["before"][-1]["text"].startswith("The effective Hamiltonian") and eq["label"] == "1"
    assert [s["text"] for s in eq["after"]][0] == "The energy follows from Eq. (1)."


def test_relations_cover_the_grid(run):
    got = {(r["src"], r["dst"]): (r["grade"], r["description"]) for r in run["relations"].collect()}
    assert got == {("1", "2"): ("strong", "explicit citation"), ("2", "1"): ("strong", "derived from")}
    validate.require(validate.relation_errors(run["equations"], run["relations"]))


def test_meanings_and_definitions(run):
    found = {r["equation_id"]: r for r in run["meanings"].collect()}
    assert found["1"]["match_source"] == "cue_pattern" and found["1"]["meaning"] == "effective Hamiltonian"
    defined = {r["canonical"]: r["definition"] for r in run["definitions"].collect()}
    assert "Hamiltonian" in defined["H"]


def test_final_object(spark, run, tmp_path):
    listed = spark.createDataFrame([(0, "p1"), (1, "empty")], "position int, paper_id string")
    final = papers.final_objects(run, listed)
    rows = final.orderBy("position").collect()
    assert rows[1]["json"] == "{}" and list(json.loads(rows[0]["json"])) == ["1", "2"]
    assert set(json.loads(rows[0]["json"])["1"]) == {"equation", "meaning", "symbols", "relations"}
    target = str(tmp_path / "final")
    sinks.write_final(final, target)
    text = "".join(r["value"] for r in spark.read.text(target).withColumn("f", F.input_file_name()).orderBy("f").collect())
    assert list(json.loads(text)) == ["p1", "empty"]
    with pytest.raises(RuntimeError):
        sinks.publish(final, target, lambda d, p: (_ for _ in ()).throw(RuntimeError("disk")))
    assert spark.read.text(target).count() == 2


def test_strict_export(spark, run):
    eqs = run["equations"].select("paper_id", "equation_id", F.col("latex").alias("equation"))
    syms = run["definitions"].select("paper_id", "equation_id", F.col("canonical").alias("symbol"), "definition")
    listed = spark.createDataFrame([(0, "p1")], "position int, paper_id string")
    assert export.strict_export(eqs, run["meanings"], syms, run["relations"], listed).count() == 2
    with pytest.raises(validate.ValidationError, match="missing"):
        export.strict_export(eqs, run["meanings"].limit(1), syms, run["relations"], listed)
    with pytest.raises(validate.ValidationError, match="paper list"):
        export.strict_export(eqs, run["meanings"], syms, run["relations"], listed.limit(0))


def test_relations_by_score(spark):
    eqs = spark.createDataFrame([("p", "1", "S1", 0, ["x", "y"], ["model"]), ("p", "2", "S1", 0, ["x", "y", "z"], ["energy"]), ("p", "3", "S2", 1, ["q"], ["other"])], "paper_id string, equation_id string, section_id string, section_position int, symbols array<string>, tokens array<string>")
    said = spark.createDataFrame([("p", "2", "s1", ["s1"], "Substituting x in Eq. (1) we obtain the energy.", 0), ("p", "3", "s2", ["s2"], "This is a special case of Eq. (1).", 0)], "paper_id string, equation_id string, sentence_id string, sentence_ids array<string>, text string, pos int")
    none = spark.createDataFrame([], "paper_id string, sentence_id string, equation_id string")
    got = {(r["src"], r["dst"]): r for r in relations.relations_by_score(eqs, said, none).collect()}
    assert len(got) == 6
    assert (got["2", "1"]["grade"], got["2", "1"]["description"]) == ("strong", "derived from")
    assert (got["3", "1"]["grade"], got["3", "1"]["description"]) == ("strong", "special case")
    assert (got["1", "2"]["grade"], got["1", "2"]["description"], got["1", "2"]["shared_symbols"]) == ("potential", "shares symbols", ["x", "y"])
    assert (got["1", "3"]["grade"], got["1", "3"]["description"]) == ("none", "")


def test_search(spark):
    chunks = spark.createDataFrame([("meaning", "p", "sentence", "Equation 3 defines the Hamiltonian omega_c", "S1", ["3"], ["omega_c"]), ("other", "p", "sentence", "unrelated words", "S2", [], []), ("far", "q", "sentence", "Hamiltonian", "S1", ["3"], ["x"])], "chunk_id string, paper_id string, chunk_type string, text string, section_id string, nearby_equation_ids array<string>, symbols array<string>").withColumn("tokens", F.split(F.lower("text"), " "))
    none = "array<string>"
    asked = spark.createDataFrame([(1, "hamiltonian equation", "p", 2)], "qid long, text string, paper_id string, top_k int").withColumn("tokens", F.split("text", " "))
    free = asked.withColumns({c: F.lit(None).cast(none) for c in ("section_ids", "chunk_types", "equation_ids", "symbol_names")})
    for method in ("bm25", "tfidf"):
        got = meanings.lexical_search(chunks, free, method).collect()
        assert [r["chunk_id"] for r in got] == ["meaning"] and got[0]["method"] == method
    strict = asked.withColumns({"section_ids": F.array(F.lit("S1")), "chunk_types": F.array(F.lit("sentence")), "equation_ids": F.array(F.lit("3")), "symbol_names": F.array(F.lit("omega_c"))})
    assert [r["chunk_id"] for r in meanings.lexical_search(chunks, strict).collect()] == ["meaning"]
    empty = free.withColumn("section_ids", F.array().cast(none))
    assert meanings.lexical_search(chunks, empty).count() == 0
    with pytest.raises(ValueError):
        meanings.lexical_search(chunks, free, "neural")
    with pytest.raises(ValueError):
        meanings.lexical_search(chunks.limit(0), free)
    bad = free.withColumn("top_k", F.lit(0))
    assert [r["error"] for r in retrieval.query_errors(bad).collect()] == ["top_k is below 1"]


def test_chunk_symbols(spark):
    chunks = spark.createDataFrame([("p", "c1", ["2", "1"]), ("p", "c2", [])], "paper_id string, chunk_id string, nearby_equation_ids array<string>")
    syms = spark.createDataFrame([("p", "1", 1, "H"), ("p", "1", 2, "a"), ("p", "2", 1, "a")], "paper_id string, equation_id string, ordinal int, canonical string")
    got = {r["chunk_id"]: r["symbols"] for r in symbols.chunk_symbols(chunks, syms).collect()}
    assert got == {"c1": ["a", "H"], "c2": []}


def test_brackets(spark):
    df = spark.createDataFrame([(["a (b", "c) d", "e)", "f", "(g"],)], "parts array<string>")
    assert df.select(context.merge_open_brackets(F.col("parts"))).first()[0] == ["a (b c) d", "e)", "f", "(g"]


def test_split_has_no_leak(spark):
    rows = spark.createDataFrame([(f"p{i % 20}", i) for i in range(40)], "paper_id string, n int")
    got = selection.hash_split(rows, "paper_id").collect()
    assert len(got) == 20 and {r["split"] for r in got} == {"train", "validation", "test"}


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("arXiv:b\n\n a \narXiv:b\n")
    listed = readers.paper_list(spark, str(tmp_path / "list.txt"))
    assert [r["paper_id"] for r in listed.orderBy("position").collect()] == ["b", "a", "b"]
    wanted = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    assert [r["paper_id"] for r in readers.ordered_papers(listed, wanted).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(validate.ValidationError):
        readers.ordered_papers(listed, spark.createDataFrame([("z",)], "paper_id string"))
    (tmp_path / "html").mkdir()
    (tmp_path / "html/x1.html").write_text("<body>")
    assert readers.html_directory(spark, str(tmp_path / "html")).first()["paper_id"] == "x1"
    (tmp_path / "json").mkdir()
    (tmp_path / "json/p.json").write_text('{"paper_id": "p", "n": 1}')
    assert readers.component_directory(spark, str(tmp_path / "json"), "paper_id string, n int").first()["n"] == 1
    (tmp_path / "json/q.json").write_text('{"paper_id": "p", "n": 1}')
    with pytest.raises(validate.ValidationError):
        readers.component_directory(spark, str(tmp_path / "json"), "paper_id string, n int")
    (tmp_path / "c.json").write_text('{"p": {"1": {"equation": "x=y"}}, "q": {}}')
    assert {(r["paper_id"], r["equation"]) for r in readers.corpus(spark, str(tmp_path / "c.json")).collect()} == {("p", "x=y"), ("q", None)}
    assert sinks.markdown_table([{"a": "x|y"}], ["a"]) == "| a |\n| --- |\n| x\\|y |"
