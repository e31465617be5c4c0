"""The whole way from pages to the final object, and queries over its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import phrases
from inkwell.functions.text import anchor_label, squeeze, word_tokens
from inkwell.operators import context, embedding, export, meanings, relations, structure, symbols
from inkwell.operators import symbol_meanings as definers
from inkwell.operators.vectors import paper_space
from inkwell.operators.chunks import build_chunks
from inkwell.operators.ordering import running_totals
from inkwell.plans.search import table
from inkwell.scratch import materialize
from inkwell.sources import html

EQUATIONS_PER_PAPER, EQUATION_TARGET = 7, 350


def chosen_equations(contexts: DataFrame, per_paper: int = EQUATIONS_PER_PAPER, target: int = EQUATION_TARGET) -> DataFrame:
    """The first equations of each paper, papers in order until the target is reached."""
    first = context.first_n(contexts, ["paper_id"], ["document_order", "raw_equation_id"], per_paper)
    sizes = first.groupBy("paper_id").agg(F.count("*").alias("n"))
    kept = running_totals(sizes, [F.col("paper_id")], before=F.col("n")).filter(F.col("before") < target).select("paper_id")
    return first.join(kept, "paper_id", "left_semi").withColumn("equation_id", F.col("ordinal").cast("string")).withColumn("label", anchor_label(F.col("anchor_id")))


def analyse(pages: DataFrame, target: int = EQUATION_TARGET, encoder: Callable = embedding.HashedEncoder) -> dict[str, DataFrame]:
    """Every component of a run over pages (paper_id, html): parsed once, each costly step written.

    `encoder` makes what turns texts into vectors, which weigh half of a meaning's score (U6, J18).
    """
    parsed = materialize(html.parse_pages(html.valid_pages(pages)), "parsed")
    sents = html.sentences(parsed)
    chunks = materialize(build_chunks(parsed), "paper-chunks")
    eqs = materialize(chosen_equations(html.equation_contexts(html.equations(parsed), sents), target=target), "equations")
    space = materialize(embedding.embed(paper_space(embedding.equation_inputs(eqs), embedding.chunk_inputs(chunks)), encoder=encoder), "vectors")
    candidates = materialize(meanings.gather_candidates(eqs, chunks), "candidates")
    found = materialize(meanings.meanings_by_blend(eqs, candidates, embedding.meaning_similarities(candidates, space)), "meanings")
    cleaned = found.withColumn("c", symbols.clean_phrase("meaning", "match_source", "meaning")).select("paper_id", "equation_id", F.col("c.meaning").alias("meaning"), "score", "match_source", "c.flagged", "c.applied", F.col("c.strategy").alias("strategy"))
    syms = materialize(symbols.equation_symbols(eqs), "symbols")
    defined = materialize(symbols.symbol_definitions(syms, eqs, sents), "definitions")
    own = syms.groupBy("paper_id", "equation_id").agg(F.collect_set("canonical").alias("symbols"))
    nodes = eqs.join(own, ["paper_id", "equation_id"], "left").select("paper_id", "equation_id", "label", "section_id", "document_order", F.transform(F.concat("before", "after"), lambda s: s["text"]).alias("texts"), "symbols")
    cited = chunks.filter("chunk_type = 'cross_reference'").select("paper_id", F.explode("visible_equation_labels").alias("label"), "document_order")
    edges = materialize(relations.relations_by_rules(nodes, cited, embedding.summary_similarities(space)), "relations")
    return {"vectors": space, "parsed": parsed, "chunks": chunks, "equations": eqs, "meanings": cleaned, "symbols": syms, "definitions": defined, "relations": edges}


def final_objects(parts: dict[str, DataFrame], papers: DataFrame) -> DataFrame:
    """(position, paper_id, json) of a run (SNK4)."""
    eqs = parts["equations"].select("paper_id", "equation_id", F.col("latex").alias("equation"))
    shown = parts["symbols"].select("paper_id", "equation_id", "canonical", F.coalesce(F.get("latex_forms", F.lit(0)), F.col("canonical")).alias("symbol"))
    told = parts["definitions"].join(shown, ["paper_id", "equation_id", "canonical"]).groupBy("paper_id", "equation_id", "symbol").agg(F.min_by("definition", "canonical").alias("definition"))
    return export.final_object(export.outer_export(eqs, parts["meanings"], told, parts["relations"]), papers)


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parse_pages(table(spark, sf_dir, "pages"), "page_id", "html", html.PLAIN)


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages: the h1."""
    return _plain(spark, sf_dir).select("paper_id", "title")


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and sentences of each page."""
    sents = html.sentences(_plain(spark, sf_dir))
    return sents.groupBy("paper_id").agg(F.count_distinct("paragraph_id").alias("n_paragraphs"), F.count("*").alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"))


def html_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages long enough that have a body (SRC4)."""
    return html.valid_pages(table(spark, sf_dir, "pages")).select("page_id")


def xref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to equations in whole texts of documents, each with a reference of every kind at its end."""
    n = F.col("doc_id") % 40
    tail = F.format_string(" See Eq. (%d), Eqs. (%d, %d), and Equations (%d)-(%d), but not (8).", n, n + 1, n + 2, n, n + 3)
    text = F.concat(squeeze(F.coalesce("text", F.lit(""))), tail)
    sents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("s").alias("section_id"), F.lit("p").alias("paragraph_id"), F.lit("p:s1").alias("sentence_id"), F.lit(0).alias("document_order"), F.lit(1).alias("order"), text.alias("text"))
    return html.cross_references(sents).select("reference_id", "reference_type", F.concat_ws(",", "targets").alias("targets"))


def symbol_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of an equation made for each part: names, forms, aliases (L1)."""
    eq = F.format_string(r"H_{%d}=\omega_{c}a^{\dagger}a+\hat{Q}_{n}+\text{noise}+%s", F.col("p_size"), F.substring("p_brand", 1, 1))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(symbols.scan_symbols(eq)).alias("s"))
    return rows.select("p_partkey", "s.canonical", F.concat_ws(",", "s.latex_forms").alias("forms"), F.concat_ws(",", "s.aliases").alias("aliases"))


def mathml_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of MathML made for each part (L4)."""
    markup = F.format_string("<math><msub><mi>ω</mi><mi>%d</mi></msub><mo>+</mo><mi>i</mi><mover><mi>Q</mi><mo>^</mo></mover></math>", F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(symbols.markup_symbols(F.array(markup), F.lit(""))).alias("s"))
    return rows.select("p_partkey", "s.canonical", F.concat_ws(",", "s.latex_forms").alias("forms"), F.concat_ws(",", "s.modifiers").alias("modifiers"))


def phrase_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the lines of documents cannot stand for a concept."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.concat_ws(",", symbols.phrase_reasons("line")).alias("reasons"))


def phrase_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept phrases of the lines of documents (X16-X19): how many are cleaned and flagged, by strategy."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("doc_id", symbols.clean_phrase("line", F.lit("source_sentence"), "line").alias("c"))
    return rows.groupBy("doc_id", F.col("c.strategy").alias("strategy")).agg(F.count("*").alias("n"), F.count_if("c.applied").alias("applied"), F.count_if("c.flagged").alias("flagged"), F.sum(F.length("c.meaning")).alias("n_chars"))


def _told(name: Column, key: Column) -> Column:
    """A sentence about omega in one of five forms, the last of which defines nothing."""
    forms = ["Here, \\omega denotes the {x}; it is fixed.", "and where \\omega is the {x}.", "We denote the {x} by \\omega.", "The {x} is denoted by \\omega.", "The {x} and \\omega are unrelated to it."]
    text = F.get(F.array(*map(F.lit, forms)), (key % len(forms)).cast("int"))
    return F.replace(text, F.lit("{x}"), name)


def definition_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by cue in sentences about parts (X11)."""
    text = _told(F.lower("p_type"), F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", symbols.define_by_cue(text, F.array(F.lit("omega"), F.lit("\\omega"))).alias("d"))
    return rows.select("p_partkey", "d.definition", "d.strategy", "d.alias")


def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as equations that mention each other by number: grades and descriptions."""
    turns = table(spark, sf_dir, "conversations")
    kinds = F.array(*map(F.lit, ["this follows from (%d).", "it is equivalent to (%d).", "a special case: (%d).", "see (%d)."]))
    said = F.when(F.col("turn") > 0, F.array(F.format_string("%s", F.replace(F.get(kinds, (F.col("turn") % 4).cast("int")), F.lit("%d"), (F.col("turn") - 1).cast("string"))))).otherwise(F.array().cast("array<string>"))
    nodes = turns.select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("string").alias("equation_id"), F.lit(None).cast("string").alias("label"), F.concat(F.lit("sec:"), F.col("role"), F.lit(":1")).alias("section_id"), F.col("turn").alias("document_order"), said.alias("texts"), F.array_distinct(word_tokens(F.col("text"))).alias("symbols"))
    none = spark.createDataFrame([], "paper_id long, label string, document_order long")
    return relations.relations_by_rules(nodes, none)


def section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a customer's orders by priority, the second of a kind with :2 and so on."""
    o = table(spark, sf_dir, "orders").withColumn("base", F.concat(F.lit("sec:"), F.col("o_orderpriority")))
    return structure.numbered_ids(o, ["o_custkey"], "o_orderkey", "base", "section_id").select("o_orderkey", "section_id")


def symbol_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of omega from sentences about the parts of each size, the best sentence of all."""
    part = table(spark, sf_dir, "part")
    rank = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    key = [F.lit("p").alias("paper_id"), F.col("p_size").cast("string").alias("equation_id"), F.lit("omega").alias("canonical")]
    results = part.select(*key, rank.alias("rank"), (F.lit(1.0) / rank).alias("score"), F.col("p_partkey").cast("string").alias("chunk_id"), F.lit("sentence").alias("chunk_type"), _told(F.lower("p_type"), F.col("p_partkey")).alias("text"), F.array().cast("array<string>").alias("nearby_equation_ids"))
    asked = part.select(*key, F.array(F.lit("omega"), F.lit("\\omega")).alias("aliases"), F.lit(False).alias("has_modifiers")).distinct()
    return definers.symbol_meanings(asked, results, generation=1).select("equation_id", "definition", "strategy", "source_chunk_id", "candidate_score", "candidate_count")


QUERIES = {f.__name__: f for f in (html_titles, html_paragraphs, html_valid, xref_parse, symbol_scan, mathml_symbols, phrase_cleanup, phrase_reasons, symbol_meanings, definition_patterns, relation_rules, section_ids)}

_EDGE = r"[^\p{L}\p{N}_]"


def _wide(pattern: str) -> str:
    """A pattern whose word boundaries, which DuckDB takes for ASCII words only, are spelled out."""
    return "(?i)" + pattern.replace(r"\s+\b(", r"\s+(").replace(r")\b", f")(?:{_EDGE}|$)").replace(r"\eqref\b", rf"\eqref(?:{_EDGE}|$)").replace(r"\b", f"(?:^|{_EDGE})")


_quoted = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
_REFERENCE = r"(?i)\b(Eqs?\.|Equations?)\s*(\([^)]{1,80}\)(?:\s*[-–—]\s*\([^)]{1,40}\))?|[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)"
_SPAN = r"^\(?\s*(\d+)\s*\)?\s*[-–—]\s*\(?\s*(\d+)\s*\)?$"
_TOLD = r"""SELECT p_partkey, p_size, replace(['Here, \omega denotes the {x}; it is fixed.', 'and where \omega is the {x}.', 'We denote the {x} by \omega.', 'The {x} is denoted by \omega.', 'The {x} and \omega are unrelated to it.'][p_partkey % 5 + 1], '{x}', lower(p_type)) AS t FROM part"""
_PRIOR = "CASE WHEN a.turn > 0 AND b.turn = a.turn - 1 THEN a.turn % 4 ELSE -1 END"
_TURNS = "SELECT *, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM conversations"
_SHARE = "CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END"
ORACLE_SQL = {
    "html_valid": "SELECT page_id FROM pages WHERE length(html) >= 500 AND regexp_matches(html, '(?i)<body')",
    "xref_parse": rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\x{{0B}}\x{{85}}\x{{1C}}-\x{{1F}}]+', ' ', 'g')) || ' See Eq. (' || doc_id % 40 || '), Eqs. (' || (doc_id % 40 + 1) || ', ' || (doc_id % 40 + 2) || '), and Equations (' || doc_id % 40 || ')-(' || (doc_id % 40 + 3) || '), but not (8).' AS t FROM documents),
        r AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_REFERENCE}', 2)) AS body, generate_subscripts(regexp_extract_all(t, '{_REFERENCE}'), 1) AS k FROM d),
        e AS (SELECT *, regexp_extract(body, '{_SPAN}', 1) AS a, regexp_extract(body, '{_SPAN}', 2) AS b, regexp_extract_all(body, '[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*') AS l FROM r),
        n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, CASE WHEN a <> '' THEN 'range' WHEN len(l) > 1 THEN 'list' ELSE 'singular' END AS reference_type,
          array_to_string(CASE WHEN a <> '' THEN [x::VARCHAR for x in generate_series(a::INT, b::INT)] ELSE l END, ',') AS targets FROM e WHERE len(l) > 0)
        SELECT doc_id || ':xref:' || k AS reference_id, reference_type, targets FROM n""",
    "phrase_reasons": rf"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
        w AS (SELECT *, [lower(x) for x in regexp_extract_all(p, '{phrases.WORD.pattern.replace("'", "''")}')] AS w, len(regexp_extract_all(p, '[A-Za-z]')) AS letters, len(regexp_extract_all(p, '[^\s\x{{0B}}\p{{Z}}]')) AS marks FROM l),
        h AS (SELECT *, len(list_filter(w, lambda x: x IN {_quoted(phrases.SCIENCE_HEADS)})) > 0 AS head FROM w)
        SELECT doc_id, pos, array_to_string(list_filter([
          CASE WHEN len(w) < 2 AND NOT head THEN 'too_short' END, CASE WHEN len(w) > {phrases.MAX_WORDS} THEN 'too_long' END,
          CASE WHEN len(list_filter(w, lambda x: x IN {_quoted(phrases.FORBIDDEN_VERBS)})) > 0 THEN 'contains_finite_or_context_verb' END,
          CASE WHEN regexp_matches(p, '{_wide(phrases.CLAUSE_BOUNDARY.pattern)}') THEN 'contains_definition_or_relative_clause' END,
          CASE WHEN regexp_matches(p, '{_wide(phrases.EQUATION_REFERENCE.pattern)}') THEN 'contains_equation_reference' END,
          CASE WHEN regexp_matches(p, '{_wide(phrases.INCOMPLETE_EDGE.pattern)}') THEN 'incomplete_or_invalid_edge' END,
          CASE WHEN {' OR '.join(f"length(replace(p, '{x}', '')) <> length(replace(p, '{y}', ''))" for x, y in ('()', '{}', '[]'))} THEN 'unbalanced_delimiters' END,
          CASE WHEN regexp_matches(p, '\\[A-Za-z]+') AND (len(w) < 2 OR marks - letters > 2 * letters) THEN 'math_dominated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h""",
    "definition_patterns": rf"""WITH t AS ({_TOLD}), m AS (SELECT p_partkey, p_partkey % 5 AS f, regexp_extract(t, '\\omega denotes the ([^.;]+)', 1) AS a, regexp_extract(t, 'where \\omega is the ([^.;]+)', 1) AS b, regexp_extract(t, '(?i)we denote the ([^.;]+?) by \\omega', 1) AS c, regexp_extract(t, '^The ([^.;]+?) is denoted by \\omega', 1) AS d FROM t)
        SELECT p_partkey, a || b || c || d AS definition, CASE WHEN a <> '' THEN 'symbol_before_cue' WHEN b <> '' THEN 'contextual_copula' WHEN c <> '' THEN 'definition_before_symbol' WHEN d <> '' THEN 'passive_definition' ELSE 'no_pattern' END AS strategy,
        CASE WHEN a || b || c || d <> '' THEN '\omega' ELSE '' END AS alias FROM m""",
    "symbol_meanings": rf"""WITH t AS ({_TOLD}), m AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r, regexp_extract(t, '\\omega denotes the ([^.;]+)', 1) || regexp_extract(t, 'where \\omega is the ([^.;]+)', 1) || regexp_extract(t, '(?i)we denote the ([^.;]+?) by \\omega', 1) || regexp_extract(t, '^The ([^.;]+?) is denoted by \\omega', 1) AS d FROM t),
        x AS (SELECT *, 4.0 + 2 + 1 + CASE WHEN contains(t, 'We denote') THEN 1 ELSE 0 END + 1.0 / r AS s FROM m),
        w AS (SELECT p_size, arg_max({{d: d, t: t, k: p_partkey, s: s}}, (s, -r)) FILTER (d <> '') AS b, count(DISTINCT lower(t)) AS n FROM x GROUP BY p_size)
        SELECT p_size::VARCHAR AS equation_id, coalesce(b.d, '') AS definition, CASE WHEN b IS NULL THEN 'no_reliable_definition' WHEN contains(b.t, ' denotes ') THEN 'symbol_before_cue' WHEN contains(b.t, 'where') THEN 'contextual_copula' WHEN contains(b.t, 'We denote') THEN 'definition_before_symbol' ELSE 'passive_definition' END AS strategy,
        b.k::VARCHAR AS source_chunk_id, round(b.s, 4) AS candidate_score, n::INT AS candidate_count FROM w""",
    "mathml_symbols": r"""SELECT p_partkey, 'omega_' || p_size AS canonical, CASE WHEN p_size < 10 THEN '\omega_' || p_size || ',' ELSE '' END || '\omega_{' || p_size || '}' AS forms, 'subscript:' || p_size AS modifiers FROM part
        UNION ALL SELECT p_partkey, 'Q_hat', '\hat{Q}', 'decorator:hat' FROM part""",
    "relation_rules": f"""SELECT a.conv_id AS paper_id, a.turn::VARCHAR AS src, b.turn::VARCHAR AS dst,
        CASE WHEN {_PRIOR} >= 0 THEN 'strong' WHEN {_SHARE} >= 0.4 OR a.role = b.role THEN 'potential' ELSE 'none' END AS grade,
        CASE {_PRIOR} WHEN 0 THEN 'derived from' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'special case' WHEN 3 THEN 'explicit citation'
        ELSE CASE WHEN {_SHARE} >= 0.4 THEN 'shares symbols' WHEN a.role = b.role THEN 'same section context' ELSE 'none' END END AS description
        FROM ({_TURNS}) a JOIN ({_TURNS}) b ON a.conv_id = b.conv_id AND a.turn <> b.turn""",
    "section_ids": "SELECT o_orderkey, 'sec:' || o_orderpriority || CASE WHEN n = 1 THEN '' ELSE ':' || n END AS section_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)",
    "html_titles": r"""SELECT page_id AS paper_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS title FROM pages""",
}
