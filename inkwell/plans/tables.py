"""Context, evaluation, validation and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.arrays import in_order, jaccard, softmax
from inkwell.functions.text import sentences, squeeze, words
from inkwell.operators import context, evaluate, export, structure, validate, windows
from inkwell.operators.chunks import build_chunks
from inkwell.operators.quality import hard_filter_reasons
from inkwell.plans.search import table
from inkwell.scratch import materialize


def asof_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error event the user's last purchase before and first after it."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    points = ev.filter("event_type = 'error'").select("user_id", "at", F.col("event_id").alias("error_id"))
    return context.asof_neighbours(points, ev.filter("event_type = 'purchase'"), ["user_id"], "at", "event_id").select("error_id", "previous", "next")


def context_window5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five whole turns before and after each turn, joined in order, as digests."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = context.nearest_rows(turns, ["conv_id"], "turn", "text", 5)
    return found.select("conv_id", "turn", F.sha2(F.concat_ws("|", "before"), 256).alias("before_text"), F.sha2(F.concat_ws("|", "after"), 256).alias("after_text"))


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's error and click whose event numbers differ by less than 200."""
    ev = table(spark, sf_dir, "events")
    a = ev.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"))
    b = ev.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"))
    return context.band_join(a, b, ["user_id"], "error_id", "click_id", 200).select("user_id", "error_id", "click_id")


def running_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation in order until 350 orders are reached, the crossing one included."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    groups = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "c_custkey", "n")
    return context.running_cutoff(groups, "n", 350, ["c_custkey"], ["c_nationkey"]).select("c_nationkey", "c_custkey", "n", "before_total")


def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven orders of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return context.first_n(orders, ["o_custkey"], ["o_orderkey"], 7)


def paren_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents merged while brackets are open (W10): how many lines are left and how long the longest is."""
    merged = table(spark, sf_dir, "documents").select("doc_id", context.merge_open_brackets(F.split("text", "\n")).alias("m"))
    return merged.select("doc_id", F.size("m").alias("n_lines"), F.array_max(F.transform("m", lambda s: F.length(s))).alias("longest"))


def nested_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier line item of the order with a smaller level, quantity standing in for the level."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("level"))
    return context.parents_by_level(items, ["l_orderkey"], "l_linenumber", "level", "l_linenumber").select("l_orderkey", "l_linenumber", "parent")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101, 4)
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold_label"), F.col("toxic").alias("predicted_label"), score.alias("score"))


LABELLED = "SELECT doc_id, quality AS gold_label, toxic AS predicted_label, round((doc_id * 37 % 101) / 101, 4) AS score FROM labels"


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    return evaluate.label_metrics(_labelled(spark, sf_dir))


def classification_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro-F1."""
    return evaluate.overall_metrics(_labelled(spark, sf_dir))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels by predicted labels."""
    return evaluate.confusion(_labelled(spark, sf_dir), [0, 1])


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest threshold whose accepted rows are of good quality nine times in ten."""
    rows = _labelled(spark, sf_dir).withColumn("good", F.col("gold_label") == 1)
    return evaluate.threshold_sweep(rows, "score", "good", 0.87, 5)


def accepted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, coverage and abstention beyond a threshold."""
    return evaluate.accepted_metrics(_labelled(spark, sf_dir), F.col("score") >= 0.6, F.col("gold_label") == 1)


def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose best of three probabilities clears threshold and margin."""
    p = [F.round(F.pmod(F.col("doc_id") * k, F.lit(100)) / 100, 2) for k in (13, 29, 57)]
    probabilities = F.create_map(F.lit("none"), p[0], F.lit("definition"), p[1], F.lit("property"), p[2])
    return table(spark, sf_dir, "labels").filter(evaluate.accepts(probabilities, "none", 0.8, 0.1)).select("doc_id")


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct sources by language and quality."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.split_summary(rows, "lang", "quality", "source")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse counts of the quality labels."""
    return evaluate.class_weights(table(spark, sf_dir, "labels"), "quality")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", squeeze(F.col("line")).alias("line")).filter("line <> ''")


LINES = r"""SELECT doc_id, pos, line FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, trim(regexp_replace(unnest(a), '[\s\p{Z}\x{0B}\x{85}]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE line <> ''"""
RE_SYMBOL = r"(?i)\b(?:where\s+\\?[A-Za-z][A-Za-z0-9_{}^\\]*\s+(?:is|are)|\\?[A-Za-z][A-Za-z0-9_{}^\\]*\s+denotes?|let\s+\\?[A-Za-z])\b"
REASONS_SQL = rf"""
SELECT doc_id, pos, list_filter([
  CASE WHEN regexp_matches(line, '^\s*(?:We|To|Note\s+that|It\s+follows)\b') THEN 'procedural' END,
  CASE WHEN len(regexp_extract_all(line, '(?:\\[A-Za-z]+|[_^{{}}=+\-*/]|[A-Za-z]_[A-Za-z0-9])')) / greatest(n, 1) > 0.4 THEN 'math_heavy' END,
  CASE WHEN regexp_matches(line, '{RE_SYMBOL}') THEN 'symbol_definition' END,
  CASE WHEN n < 5 OR line LIKE '%,' OR line LIKE '%:' OR len(line) - len(replace(line, '(', '')) > len(line) - len(replace(line, ')', '')) THEN 'incomplete' END
], lambda r: r IS NOT NULL) AS reasons FROM (SELECT *, len(regexp_extract_all(line, '[A-Za-z0-9]+')) AS n FROM ({LINES}))"""


def hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against each line as a candidate."""
    return _sentences(spark, sf_dir).select("doc_id", "pos", F.concat_ws(",", hard_filter_reasons(F.col("line"))).alias("reasons"))


def overlapping_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and distinct documents for each reason."""
    rows = _sentences(spark, sf_dir).select("doc_id", hard_filter_reasons(F.col("line")).alias("reasons"))
    return evaluate.reason_counts(rows, "doc_id", "reasons")


def reason_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each reason."""
    rows = _sentences(spark, sf_dir).select("doc_id", hard_filter_reasons(F.col("line")).alias("reasons"))
    return evaluate.examples_per_reason(rows, "doc_id", "reasons", 3)


def exclusive_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each document's length and words, in percent."""
    n = F.size(words(F.col("text")))
    reason = F.when(n < 20, "too_short").when(n > 800, "too_long").otherwise("fits")
    return evaluate.exclusive_reasons(table(spark, sf_dir, "documents"), reason)


def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest number of words by language."""
    return evaluate.length_summary(table(spark, sf_dir, "documents"), "lang", F.size(words(F.col("text"))))


def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunk views of documents as papers: a line is a paragraph, counted by type."""
    none = F.lit(0).cast("int")
    sents = lambda p: F.transform(sentences(p["line"]), lambda s, k: F.struct(F.concat_ws(":", p["pos"].cast("string"), k.cast("string")).alias("sentence_id"), k.cast("int").alias("order"), s.alias("text"), none.alias("start"), none.alias("end")))
    paras = lambda p: F.struct(p["pos"].cast("string").alias("paragraph_id"), F.lit("s").alias("section_id"), p["pos"].cast("int").alias("document_order"), p["line"].alias("text"), sents(p).alias("sentences"))
    listed = _sentences(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    section = F.struct(F.lit("s").alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), none.alias("order"), none.alias("level"), F.lit("section").alias("kind"), F.lit("t").alias("title"), F.lit(True).alias("synthetic"))
    equation = "array<struct<raw_equation_id:string,anchor_id:string,visible_labels:array<string>,latex:string,mathml:array<string>,document_order:int,section_id:string>>"
    parsed = listed.select(F.col("doc_id").alias("paper_id"), F.array(section).alias("sections"), F.transform("lines", paras).alias("paragraphs"), F.array().cast(equation).alias("equations"))
    views = build_chunks(materialize(parsed, "parsed")).filter("chunk_type <> 'cross_reference'")
    return views.groupBy(F.col("paper_id").alias("doc_id"), "chunk_type").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation joined in order, and the first of them."""
    joined = context.joined_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return joined.select("conv_id", F.sha2("text", 256).alias("digest"), F.col("first").alias("first_turn"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each text has and how long they are, split after . ! ? (X4, simple form)."""
    parts = sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n_sentences"), F.coalesce(F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + F.length(s)), F.lit(0)).alias("n_chars_in"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types in order of first occurrence."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.concat_ws(",", in_order(F.collect_list(F.struct("event_id", F.col("event_type").alias("value"))))).alias("types"))


def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that are not English, and English ones without a label."""
    expected = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"))
    return validate.coverage(expected, table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("k")), ["k"])


def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal texts, labels without documents, and texts without words, as (entity, error) (V1, V2)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return validate.gather(
        validate.not_unique(docs.select("text"), ["text"], F.sha2("text", 256), "text"),
        validate.not_found(labels, ["doc_id"], docs, ["doc_id"], F.col("doc_id").cast("string"), "document"),
        validate.wrong(docs, F.size(words(F.col("text"))) < 5, F.col("doc_id").cast("string"), "few words"),
    )


def outer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as nested objects of items and links, defaults where nothing is known."""
    orders, symbols, relations = _components(spark, sf_dir)
    key = ["paper_id", "equation_id"]
    done = export.outer_export(orders, orders.filter("status = 'F'").select(*key, F.lit("done").alias("meaning")), symbols, relations)
    return done.select(*key, "equation", "meaning", F.size("symbols").alias("n_symbols"), F.size("relations").alias("n_relations"), F.concat_ws(",", F.map_values("symbols")).alias("definitions"))


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as equations of customers, line items as their symbols, orders of equal status as related."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderkey").cast("string").alias("equation_id"), F.col("o_orderpriority").alias("equation"), F.col("o_orderstatus").alias("status"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("equation_id"), F.col("l_linenumber").cast("string").alias("symbol"), F.col("l_returnflag").alias("definition")).groupBy("equation_id", "symbol").agg(F.min("definition").alias("definition"))
    key = ["paper_id", "equation_id"]
    symbols = orders.select(*key).join(items, "equation_id").select(*key, "symbol", "definition")
    pairs = orders.select("paper_id", F.col("equation_id").alias("src"), F.col("status").alias("a")).join(orders.select("paper_id", F.col("equation_id").alias("dst"), F.col("status").alias("b")), "paper_id").filter("src <> dst")
    return orders, symbols, pairs.filter("a = b").select("paper_id", "src", "dst", F.lit("potential").alias("grade"), F.lit("same status").alias("description"))


def final_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object for each customer: orders by number, with their items and links (SNK4, A28, S5)."""
    orders, symbols, relations = _components(spark, sf_dir)
    done = export.outer_export(orders, orders.filter("status = 'F'").select("paper_id", "equation_id", F.lit("done").alias("meaning")), symbols, relations)
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.col("c_custkey").cast("string").alias("paper_id"))
    return export.final_object(done, papers).select("paper_id", F.sha2("json", 256).alias("digest"), F.length("json").alias("n_chars"))


def strict_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where every order must have a meaning and every pair a relation."""
    orders, symbols, _ = _components(spark, sf_dir)
    key = ["paper_id", "equation_id"]
    side = lambda name: orders.select("paper_id", F.col("equation_id").alias(name), F.col("status").alias(f"_{name}"))
    every = side("src").join(side("dst"), "paper_id").filter("src <> dst").select("paper_id", "src", "dst", F.when(F.col("_src") == F.col("_dst"), "potential").otherwise("none").alias("grade"), F.lit("").alias("description"))
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"))
    done = export.strict_export(orders, orders.select(*key, F.col("status").alias("meaning")), symbols, every, papers)
    return done.select(*key, "equation", "meaning", F.size("symbols").alias("n_symbols"), F.size(F.filter(F.map_values("relations"), lambda r: r["grade"] == "potential")).alias("n_kept"), F.size("relations").alias("n_relations"))


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of clicks among a user's events as spans (O3, gaps and islands)."""
    ev = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("int") - 1
    rows = ev.select(F.col("user_id").alias("text_id"), (2 * place).alias("start"), (2 * place + 1).alias("end"), F.when(F.col("event_type") == "click", "I-EQ_NAME").when(F.col("event_type") == "error", "B-EQ_NAME").otherwise("O").alias("entity"))
    texts = rows.groupBy("text_id").agg(F.repeat(F.lit("x "), F.count("*").cast("int")).alias("text"))
    return windows.entity_spans(rows, texts).select("text_id", "start", "end", F.length("span").alias("n"))


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as answers: documents' own against the one before."""
    docs = table(spark, sf_dir, "documents").select(F.lit("p").alias("paper_id"), F.col("doc_id").alias("equation_id"), F.col("source").alias("meaning"), (F.col("doc_id") % 3 > 0).alias("has_answer"))
    gold = docs.withColumn("meaning", F.when(F.col("has_answer"), F.col("meaning")).otherwise(""))
    said = docs.select("paper_id", (F.col("equation_id") + 1).alias("equation_id"), F.when(F.col("equation_id") % 4 > 0, F.col("meaning")).otherwise("").alias("meaning"))
    return windows.answer_metrics(gold, said)


def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' parts that are known and unknown, in order and each once."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("targets"))
    known = table(spark, sf_dir, "part").filter("p_size > 25").select(F.lit(1).alias("paper_id"), F.col("p_partkey").cast("string").alias("equation_id"))
    found = structure.split_labels(items.withColumn("paper_id", F.lit(1)), known)
    return found.select("l_orderkey", F.concat_ws(",", "resolved").alias("resolved"), F.concat_ws(",", "unresolved").alias("unresolved"))


def paper_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and errors of each customer, and sums over all (A1)."""
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    totals = structure.paper_totals(papers, orders=table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id")), errors=table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("paper_id")))
    return totals.unionByName(structure.overall_totals(totals).select((-F.col("n_papers")).alias("paper_id"), "n_orders", "n_errors"))


def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment, in order."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("paper_id"))
    return export.grouped_reasons(rows).select("status", "n", F.concat_ws(",", F.transform("papers", lambda p: p.cast("string"))).alias("papers"))


def ordered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as sections by price and id."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.floor(F.col("o_totalprice") / 10000).alias("position"), F.col("o_orderkey").cast("string").alias("section_id"))
    return structure.ordered_sections(rows).select("section_id", "order")


def equation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns around each turn as evidence; a turn that another turn comes after introduces that one."""
    turns = table(spark, sf_dir, "conversations").filter("turn % 2 = 0").select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("string").alias("equation_id"), F.col("turn").alias("document_order"), (F.col("turn") - 1).cast("string").alias("previous_paragraph_id"), (F.col("turn") + 1).cast("string").alias("next_paragraph_id"))
    said = table(spark, sf_dir, "conversations").filter("turn % 2 = 1").select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("string").alias("paragraph_id"), F.col("turn").cast("string").alias("sentence_id"), F.lit("s").alias("section_id"), "text", F.lit(0).alias("order"))
    return structure.equation_evidence(turns, said).select("paper_id", "equation_id", "sentence_id", "position", "pos", F.length("text").alias("n_chars"))


def softmax_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three scores of each label, and the lead of the first over the second (M5)."""
    scores = F.array(*[F.pmod(F.col("doc_id") * k, F.lit(17)).cast("double") / 4 for k in (3, 5, 7)])
    ranked = F.sort_array(softmax(scores), asc=False)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(F.get(ranked, F.lit(0)), 6).alias("best"), F.round(F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)), 6).alias("lead"))


def directed_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of turns of a conversation with the overlap of their words; pairs without any are `none`."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("w"))
    other = turns.select("conv_id", F.col("turn").alias("dst"), F.col("w").alias("v"))
    pairs = turns.withColumnRenamed("turn", "src").join(other, "conv_id").filter("src <> dst")
    score = jaccard(F.col("w"), F.col("v"))
    grade = F.when(score >= 0.4, "potential").otherwise("none")
    return pairs.select("conv_id", "src", "dst", F.round(score, 6).alias("score"), grade.alias("grade"))


def rank_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart a customer's consecutive orders are in price rank."""
    o = table(spark, sf_dir, "orders")
    return context.rank_distance(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_orderkey"]).select("o_orderkey", "distance")


QUERIES = {
    f.__name__: f
    for f in (
        asof_prev_next, context_window5, band_join, running_cutoff, first_n_per_group, paren_sessions, nested_levels, classification_report, classification_overall, confusion, threshold_sweep, accepted_metrics,
        acceptance_gate, split_summary, class_weights, hard_filter, overlapping_reasons, reason_examples, exclusive_reasons, length_summary, chunk_union, section_context, sentence_split, ordered_distinct,
        coverage_antijoin, document_checks, outer_export, directed_pairs_grid, rank_distance, final_object, strict_export, entity_spans, answer_metrics, split_labels, paper_totals, status_groups, ordered_sections,
        equation_evidence, softmax_margin,
    )
}

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
P = "round((doc_id * {k} % 100) / 100, 2)"
ORACLE_SQL = {
    "asof_prev_next": """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase')
        SELECT event_id AS error_id, (SELECT arg_max(p.event_id, (p.at, p.event_id)) FROM p WHERE p.user_id = x.user_id AND p.at < x.at) AS previous,
        (SELECT arg_min(p.event_id, (p.at, p.event_id)) FROM p WHERE p.user_id = x.user_id AND p.at > x.at) AS next FROM e x WHERE event_type = 'error'""",
    "context_window5": """SELECT conv_id, turn, sha256(coalesce(string_agg(text, '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')) AS before_text,
        sha256(coalesce(string_agg(text, '|' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '')) AS after_text FROM conversations""",
    "band_join": "SELECT a.user_id, a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND abs(a.event_id - b.event_id) < 200 WHERE a.event_type = 'error' AND b.event_type = 'click'",
    "running_cutoff": """SELECT * FROM (SELECT c_nationkey, c_custkey, n, coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_total
        FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey) WHERE before_total < 350""",
    "first_n_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders) WHERE ordinal <= 7",
    "nested_levels": """WITH i AS (SELECT l_orderkey, l_linenumber, floor(min(l_quantity))::INT AS level FROM lineitem GROUP BY 1, 2)
        SELECT a.l_orderkey, a.l_linenumber, max(b.l_linenumber) AS parent FROM i a LEFT JOIN i b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.level < a.level GROUP BY ALL""",
    "classification_report": f"""WITH r AS ({LABELLED}), l AS (SELECT DISTINCT unnest([gold_label, predicted_label]) AS label FROM r),
        s AS (SELECT label, (SELECT count(*) FROM r WHERE gold_label = label) AS g, (SELECT count(*) FROM r WHERE predicted_label = label) AS p, (SELECT count(*) FROM r WHERE gold_label = label AND predicted_label = label) AS t FROM l)
        SELECT label, round(CASE WHEN p = 0 THEN 0 ELSE t / p END, 6) AS precision, round(CASE WHEN g = 0 THEN 0 ELSE t / g END, 6) AS recall, round(CASE WHEN g + p = 0 THEN 0 ELSE 2 * t / (g + p) END, 6) AS f1, g AS support FROM s""",
    "classification_overall": f"""WITH r AS ({LABELLED}), l AS (SELECT DISTINCT gold_label AS label FROM r),
        s AS (SELECT label, (SELECT count(*) FROM r WHERE gold_label = label) AS g, (SELECT count(*) FROM r WHERE predicted_label = label) AS p, (SELECT count(*) FROM r WHERE gold_label = label AND predicted_label = label) AS t FROM l)
        SELECT (SELECT round(avg((gold_label = predicted_label)::INT), 6) FROM r) AS accuracy, round(avg(round(2 * t / (g + p), 6)), 6) AS macro_f1, (SELECT count(*) FROM r) AS n FROM s""",
    "confusion": f"SELECT gold_label, count(*) FILTER (predicted_label = 0) AS predicted_0, count(*) FILTER (predicted_label = 1) AS predicted_1 FROM ({LABELLED}) GROUP BY gold_label",
    "threshold_sweep": f"""SELECT threshold, accepted, round(good / accepted, 6) AS precision FROM (SELECT score AS threshold, sum(n) OVER (ORDER BY score DESC)::BIGINT AS accepted, sum(g) OVER (ORDER BY score DESC)::BIGINT AS good
        FROM (SELECT score, count(*) AS n, sum(gold_label) AS g FROM ({LABELLED}) GROUP BY score)) WHERE good / accepted >= 0.87 AND accepted >= 5 ORDER BY accepted DESC, threshold DESC LIMIT 1""",
    "accepted_metrics": f"""SELECT n, a AS accepted, round(g / a, 6) AS precision, round(a / n, 6) AS coverage, round(1 - a / n, 6) AS abstention FROM (SELECT count(*) AS n, count(*) FILTER (score >= 0.6) AS a, count(*) FILTER (score >= 0.6 AND gold_label = 1) AS g FROM ({LABELLED}))""",
    "acceptance_gate": f"""SELECT doc_id FROM (SELECT doc_id, list_sort([a, b, c], 'DESC') AS s, a, b, c FROM (SELECT doc_id, {P.format(k=13)} AS a, {P.format(k=29)} AS b, {P.format(k=57)} AS c FROM labels))
        WHERE s[1] >= 0.8 AND s[1] - s[2] >= 0.1 AND s[1] <> a""",
    "split_summary": "SELECT lang, quality, count(*) AS n, count(DISTINCT source) AS papers FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality",
    "class_weights": "SELECT quality, round(1 / count(*), 9) AS weight FROM labels GROUP BY quality",
    "hard_filter": f"SELECT doc_id, pos, array_to_string(reasons, ',') AS reasons FROM ({REASONS_SQL})",
    "overlapping_reasons": f"SELECT reason, count(*) AS candidates, count(DISTINCT doc_id) AS records FROM (SELECT doc_id, unnest(reasons) AS reason FROM ({REASONS_SQL})) GROUP BY reason",
    "reason_examples": f"SELECT * FROM (SELECT doc_id, reason, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS ordinal FROM (SELECT DISTINCT doc_id, unnest(reasons) AS reason FROM ({REASONS_SQL}))) WHERE ordinal <= 3",
    "exclusive_reasons": f"SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM (SELECT CASE WHEN len({WORDS}) < 20 THEN 'too_short' WHEN len({WORDS}) > 800 THEN 'too_long' ELSE 'fits' END AS reason FROM documents) GROUP BY reason",
    "length_summary": f"SELECT lang, min(n) AS low, median(n) AS middle, max(n) AS high, count(*) AS n_docs FROM (SELECT lang, len({WORDS}) AS n FROM documents) GROUP BY lang",
    "chunk_union": rf"""WITH l AS ({LINES}) SELECT doc_id, chunk_type, count(*) AS n_chunks, sum(n)::BIGINT AS n_chars FROM (
        SELECT doc_id, 'sentence' AS chunk_type, length(s) AS n FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM l) WHERE s <> ''
        UNION ALL SELECT doc_id, 'paragraph', length(line) FROM l UNION ALL SELECT doc_id, 'section_context', sum(length(line)) + 2 * (count(*) - 1) FROM l GROUP BY doc_id) GROUP BY ALL""",
    "section_context": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest, min(turn) AS first_turn FROM conversations GROUP BY conv_id",
    "sentence_split": r"SELECT doc_id, len(s) AS n_sentences, coalesce(list_sum([length(x) for x in s]), 0)::BIGINT AS n_chars_in FROM (SELECT doc_id, list_filter([trim(y) for y in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x <> '') AS s FROM documents)",
    "ordered_distinct": "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id",
    "coverage_antijoin": "WITH d AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT DISTINCT doc_id AS k, 'missing' AS error FROM labels WHERE doc_id NOT IN (FROM d) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "document_checks": f"""SELECT sha256(text) AS entity, 'duplicate text' AS error FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT doc_id::VARCHAR, 'unknown document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id::VARCHAR, 'few words' FROM documents WHERE len({WORDS}) < 5""",
    "final_object": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS equation, o_orderstatus AS status FROM orders),
        i AS (SELECT l_orderkey AS k, '{' || string_agg('"' || l || '":"' || f || '"', ',' ORDER BY l::VARCHAR) || '}' AS s FROM (SELECT l_orderkey, l_linenumber AS l, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1),
        r AS (SELECT a.k, '{' || string_agg('"' || b.k || '":{"grade":"potential","description":"same status"}', ',' ORDER BY b.k::VARCHAR) || '}' AS r FROM o a JOIN o b ON a.c = b.c AND a.k <> b.k AND a.status = b.status GROUP BY a.k),
        j AS (SELECT c, '{' || string_agg('"' || k || '":{"equation":"' || equation || '","meaning":"' || CASE WHEN status = 'F' THEN 'done' ELSE '' END || '","symbols":' || coalesce(s, '{}') || ',"relations":' || coalesce(r, '{}') || '}', ',' ORDER BY k) || '}' AS json
          FROM o LEFT JOIN i USING (k) LEFT JOIN r USING (k) GROUP BY c)
        SELECT c_custkey::VARCHAR AS paper_id, sha256(coalesce(json, '{}')) AS digest, length(coalesce(json, '{}')) AS n_chars FROM customer LEFT JOIN j ON c = c_custkey""",
    "strict_export": """WITH o AS (SELECT o_custkey::VARCHAR AS paper_id, o_orderkey::VARCHAR AS equation_id, o_orderpriority AS equation, o_orderstatus AS meaning FROM orders),
        i AS (SELECT l_orderkey::VARCHAR AS equation_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
        SELECT paper_id, equation_id, equation, meaning, coalesce(n, 0) AS n_symbols, count(*) OVER (PARTITION BY paper_id, meaning) - 1 AS n_kept, count(*) OVER (PARTITION BY paper_id) - 1 AS n_relations FROM o LEFT JOIN i USING (equation_id)""",
    "entity_spans": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
        k AS (SELECT *, CASE WHEN event_type = 'click' AND lag(p) OVER (PARTITION BY user_id ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS fresh FROM e WHERE event_type IN ('click', 'error')),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY p) AS island FROM k)
        SELECT user_id AS text_id, (2 * min(p))::INT AS start, (2 * max(p) + 1)::INT AS end, (2 * (max(p) - min(p)) + 1)::INT AS n FROM s GROUP BY user_id, island""",
    "answer_metrics": """WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS m, doc_id % 3 > 0 AS h FROM documents), p AS (SELECT doc_id + 1 AS doc_id, CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END AS p FROM documents),
        r AS (SELECT m, h, coalesce(p, '') AS p FROM g LEFT JOIN p USING (doc_id))
        SELECT round(avg((p = m)::INT), 6) AS exact_match, round(count(*) FILTER (p = m AND p <> '') / count(*) FILTER (p <> ''), 6) AS answer_precision, round(count(*) FILTER (p = m AND h) / count(*) FILTER (h), 6) AS answer_recall,
        round(count(*) FILTER (p = '' AND NOT h) / count(*) FILTER (NOT h), 6) AS no_answer_accuracy FROM r""",
    "split_labels": """WITH l AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2), k AS (SELECT l.*, p_size > 25 AS known FROM l LEFT JOIN part ON l_partkey = p_partkey)
        SELECT l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY place, l_partkey) FILTER (known), '') AS resolved, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY place, l_partkey) FILTER (known IS NOT TRUE), '') AS unresolved FROM k GROUP BY l_orderkey""",
    "paper_totals": """WITH t AS (SELECT c_custkey AS paper_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS n_errors FROM customer)
        SELECT * FROM t UNION ALL SELECT -count(*), sum(n_orders)::BIGINT, sum(n_errors)::BIGINT FROM t""",
    "status_groups": "SELECT c_mktsegment AS status, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS papers FROM customer GROUP BY 1",
    "ordered_sections": """SELECT o_orderkey::VARCHAR AS section_id, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 10000), o_orderkey::VARCHAR) AS "order" FROM orders""",
    "equation_evidence": """WITH e AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0), s AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE turn % 2 = 1)
        SELECT e.conv_id AS paper_id, e.turn::VARCHAR AS equation_id, s.turn::VARCHAR AS sentence_id, CASE WHEN s.turn < e.turn THEN 'before_equation' WHEN EXISTS (FROM e f WHERE f.conv_id = e.conv_id AND f.turn = s.turn + 1) THEN 'introduces_other_equation' ELSE 'after_equation' END AS position,
        row_number() OVER (PARTITION BY e.conv_id, e.turn ORDER BY s.turn) - 1 AS pos, n AS n_chars FROM e JOIN s ON e.conv_id = s.conv_id AND abs(e.turn - s.turn) = 1""",
    "softmax_margin": """WITH s AS (SELECT doc_id, [(doc_id * k % 17) / 4.0 for k in [3, 5, 7]] AS v FROM labels), e AS (SELECT doc_id, list_sort([exp(x - list_max(v)) for x in v], 'DESC') AS p FROM s)
        SELECT doc_id, round(p[1] / list_sum(p), 6) AS best, round((p[1] - p[2]) / list_sum(p), 6) AS lead FROM e""",
    "outer_export": """WITH o AS (SELECT o_custkey::VARCHAR AS paper_id, o_orderkey::VARCHAR AS equation_id, o_orderpriority AS equation, o_orderstatus AS status FROM orders),
        i AS (SELECT equation_id, count(*) AS n, string_agg(f, ',' ORDER BY s) AS d FROM (SELECT l_orderkey::VARCHAR AS equation_id, l_linenumber::VARCHAR AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1)
        SELECT paper_id, o.equation_id, equation, CASE WHEN status = 'F' THEN 'done' ELSE '' END AS meaning, coalesce(n, 0) AS n_symbols,
        (SELECT count(*) FROM o p WHERE p.paper_id = o.paper_id AND p.equation_id <> o.equation_id AND p.status = o.status) AS n_relations, coalesce(d, '') AS definitions FROM o LEFT JOIN i ON o.equation_id = i.equation_id""",
    "directed_pairs_grid": r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS w FROM conversations),
        s AS (SELECT a.conv_id, a.turn AS src, b.turn AS dst, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS x FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
        SELECT conv_id, src, dst, round(x, 6) AS score, CASE WHEN x >= 0.4 THEN 'potential' ELSE 'none' END AS grade FROM s""",
    "rank_distance": """SELECT o_orderkey, abs(place - lag(place) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders)""",
}
