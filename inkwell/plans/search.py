"""Search, similarity and deduplication queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.arrays import jaccard, min_max
from inkwell.functions.text import bigrams, token_set, word_tokens
from inkwell.operators import resolve, retrieval, selection, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", word_tokens(F.col("text")).alias("tokens"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), word_tokens(F.col("text")).alias("tokens"))


TOKENS = "SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM documents"
BM25_SQL = f"""
docs AS ({TOKENS}),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
terms AS (SELECT qid, term, count(*) AS qf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT qid, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.5 + 1) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM post JOIN dfs USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY qid, doc_id HAVING score > 0)"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text."""
    return retrieval.bm25_top(_docs(spark, sf_dir), _asked(spark, sf_dir), 10).select("qid", "doc_id", "rank", "score")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among English documents of two sources; statistics stay those of the corpus (F1, Q4)."""
    wanted = F.col("lang").isin("en") & F.col("source").isin("src1", "src2")
    return retrieval.bm25_top(_docs(spark, sf_dir), _asked(spark, sf_dir), 5, wanted).select("qid", "doc_id", "rank", "score")


def bm25_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the query's best, the ten best of each."""
    best = retrieval.bm25_top(_docs(spark, sf_dir), _asked(spark, sf_dir), 10)  # a query's best is among them
    return retrieval.normalised(best).select("qid", "doc_id", "rank", "norm_score")


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark text by TF-IDF over tokens and bigrams."""
    grams = lambda df: df.withColumn("tokens", F.concat("tokens", bigrams(F.col("tokens"))))
    scored = retrieval.tfidf(grams(_docs(spark, sf_dir)), grams(_asked(spark, sf_dir)))
    return retrieval.top_k(scored, 5).select("qid", "doc_id", "rank", "score")


GRAMS = "list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])"
TFIDF_SQL = f"""
WITH docs AS (SELECT doc_id, {GRAMS} AS g FROM (SELECT doc_id, tokens AS t FROM ({TOKENS}))),
each AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM each GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS w FROM each JOIN dfs USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
q AS (SELECT qid, term, count(*) * any_value(ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + df)) + 1) AS qw
  FROM (SELECT item_id AS qid, unnest({GRAMS}) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)) JOIN dfs USING (term) GROUP BY qid, term),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY qid),
scored AS (SELECT qid, doc_id, round(any_value(dot) / (any_value(norm) * any_value(qnorm)), 6) AS score
  FROM (SELECT qid, doc_id, sum(w * qw) AS dot FROM w JOIN q USING (term) GROUP BY qid, doc_id) JOIN norms USING (doc_id) JOIN qn USING (qid) GROUP BY qid, doc_id HAVING score > 0)
SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, sf_dir, "embeddings")
    return corpus, corpus.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 20."""
    return vectors.cosine_top_k(*_vectors(spark, sf_dir), k=10)


def vector_best_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the nearest vector of every label, the smallest id among equals (A10)."""
    corpus, asked = _vectors(spark, sf_dir)
    return vectors.cosine_top_k(corpus, asked, k=1, by="label").drop("rank")


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest among some labels, without excluded owners; vectors with no owner stay."""
    corpus, asked = _vectors(spark, sf_dir)
    owned = corpus.withColumns({"kind": F.col("label").cast("string"), "owner": F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("eq"), (F.col("vec_id") % 7).cast("string")))})
    return vectors.cosine_top_k(vectors.kept_kinds(owned, ["1", "2", "3"], ["eq1", "eq2"], "kind", "owner"), asked, k=5)


DOTS_SQL = "SELECT q.vec_id AS qid, v.vec_id, v.label, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id"


def minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the min-max scaled length and half the quality label within each source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id").select("doc_id", "source", F.col("n_chars").cast("double").alias("n"), "quality")
    scaled = joined.withColumn("scaled", min_max(F.col("n"), Window.partitionBy("source")))
    return scaled.select("doc_id", F.round(F.col("scaled"), 6).alias("scaled"), F.round(0.5 * F.col("scaled") + 0.5 * F.col("quality"), 6).alias("blend"))


STOP = ["the", "and", "of", "to", "in", "is", "as", "la", "le", "de"]


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the token sets of benchmark items that share a token, 0.03 and more."""
    sets = table(spark, sf_dir, "benchmark").select("item_id", token_set(word_tokens(F.col("text")), STOP).alias("s"))
    other = sets.select(F.col("item_id").alias("other_id"), F.col("s").alias("t"))
    on = sets.select("item_id", F.explode("s").alias("w")).join(other.select("other_id", F.explode("t").alias("w")), "w").filter("item_id < other_id").select("item_id", "other_id").distinct()
    scored = on.join(sets, "item_id").join(other, "other_id").select("item_id", "other_id", F.round(jaccard(F.col("s"), F.col("t")), 6).alias("score"))
    return scored.filter("score >= 0.03")


def dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the longest stays, in the slot of the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    return selection.dedupe_priority(docs, F.col("digest"), "n_chars", "doc_id").select("doc_id", "slot", "n_chars")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language and lower-cased text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("low"))
    return selection.dedupe_first(docs, F.sha2("low", 256), "doc_id", ("lang",)).select("doc_id", "lang")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in train, validation and test by rank of their digest."""
    return selection.hash_split(table(spark, sf_dir, "documents"), "source", "7")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of least digest for each language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return selection.stratified_sample(docs, "lang", F.col("doc_id"), 5).select("lang", "doc_id", "rank")


def priority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers resolved to a supplier by name number, else by nation and rounded balance if unique."""
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("bal"))
    right = table(spark, sf_dir, "supplier")
    by_key = right.select(F.col("s_suppkey").alias("target"), F.col("s_suppkey").alias("k"))
    by_nation = right.select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("nk"), F.floor(F.col("s_acctbal") / 100).alias("b"))
    steps = [("key", by_key, [(F.col("c_custkey"), "k")]), ("nation_balance", by_nation, [(F.col("c_nationkey"), "nk"), (F.floor(F.col("bal") / 100), "b")])]
    return selection.priority_cascade(left, "c_custkey", steps, "target").select("c_custkey", "target", "match_method")


def equation_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers matched with parts by id, anchor, label and LaTeX, five steps in their order."""
    part = table(spark, sf_dir, "part")
    sized = lambda form: F.when(F.col("p_size").isNotNull(), F.format_string(form, F.col("p_size")))
    tables = part.select(
        (F.col("p_partkey") % 40).alias("paper_id"), F.col("p_partkey").alias("table_id"), F.col("p_size").alias("document_order"),
        F.array(F.concat(F.lit("T"), F.col("p_partkey").cast("string")), F.concat(F.lit("B"), F.col("p_brand"))).alias("dom_ids"),
        F.array(F.col("p_brand"), F.col("p_type")).alias("labels"), F.array(resolve.normal_latex(sized(r"\left(x_{%d}\right)"))).alias("forms"),
    )
    key = F.col("c_custkey")
    entries = table(spark, sf_dir, "customer").join(part.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("c_custkey") % 200 + 1 == F.col("p_partkey")).select(
        (key % 40).alias("paper_id"), F.when(key % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("equation_id"), key.alias("c_custkey"), sized("( x_%d )").alias("equation"),
        F.when(key % 7 == 0, F.array(F.lit("none"), F.concat(F.lit("T"), key.cast("string")))).otherwise(F.array().cast("array<string>")).alias("annotation_ids"),
        F.when(key % 5 == 0, F.concat(F.lit("B"), F.col("p_brand"))).alias("audit_anchor_id"),
    )
    once = selection.dedupe_first(entries, F.concat_ws("/", "paper_id", "equation_id"), "c_custkey")
    return resolve.resolve(once, tables).select("c_custkey", "table_id", "match_method")


QUERIES = {f.__name__: f for f in (equation_resolver, bm25_topk, bm25_filtered, bm25_normalised, tfidf_topk, vector_topk, vector_best_per_label, vector_filtered, minmax_blend, jaccard_pairs, dedupe_priority, dedupe_first, hash_split, stratified_sample, priority_cascade)}

ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25_SQL} SELECT qid, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "bm25_filtered": f"WITH {BM25_SQL} SELECT qid, doc_id, rank, score FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored JOIN docs USING (doc_id) WHERE lang = 'en' AND source IN ('src1', 'src2')) WHERE rank <= 5",
    "bm25_normalised": f"WITH {BM25_SQL} SELECT qid, doc_id, rank, norm_score FROM (SELECT qid, doc_id, round(score / max(score) OVER (PARTITION BY qid), 6) AS norm_score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "tfidf_topk": TFIDF_SQL,
    "vector_topk": f"SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({DOTS_SQL})) WHERE rank <= 10",
    "vector_best_per_label": f"SELECT qid, label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS rank FROM ({DOTS_SQL})) WHERE rank = 1",
    "vector_filtered": f"SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({DOTS_SQL}) WHERE label IN (1, 2, 3) AND (vec_id % 3 = 0 OR vec_id % 7 NOT IN (1, 2))) WHERE rank <= 5",
    "minmax_blend": """SELECT doc_id, round(s, 6) AS scaled, round(0.5 * s + 0.5 * quality, 6) AS blend FROM (
        SELECT doc_id, quality, CASE WHEN hi - lo <= 1e-8 THEN 0.5 ELSE (n - lo) / (hi - lo) END AS s FROM (
        SELECT doc_id, quality, n_chars::DOUBLE AS n, min(n_chars::DOUBLE) OVER (PARTITION BY source) AS lo, max(n_chars::DOUBLE) OVER (PARTITION BY source) AS hi FROM documents JOIN labels USING (doc_id)))""",
    "jaccard_pairs": f"""WITH s AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(w) for w in STOP)}))) AS s FROM benchmark)
        SELECT item_id, other_id, score FROM (SELECT a.item_id, b.item_id AS other_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM s a JOIN s b ON a.item_id < b.item_id) WHERE score >= 0.03""",
    "dedupe_priority": "SELECT doc_id, slot, n_chars FROM (SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY text) AS slot, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1",
    "equation_resolver": r"""WITH t AS (SELECT p_partkey % 40 AS paper, p_partkey AS id, p_size AS place, 'T' || p_partkey AS d1, 'B' || p_brand AS d2, p_brand, p_type, '(x_' || p_size || ')' AS form FROM part),
        e AS (SELECT * FROM (SELECT c_custkey, c_custkey % 40 AS paper, CASE WHEN c_custkey % 3 = 0 THEN p_type ELSE p_brand END AS eq, '(x_' || p_size || ')' AS form, CASE WHEN c_custkey % 7 = 0 THEN 'T' || c_custkey END AS ann, CASE WHEN c_custkey % 5 = 0 THEN 'B' || p_brand END AS anchor
          FROM customer JOIN part ON c_custkey % 200 + 1 = p_partkey) QUALIFY row_number() OVER (PARTITION BY paper, eq ORDER BY c_custkey) = 1),
        d AS (SELECT paper, dom, arg_min(id, place) AS id FROM (SELECT paper, id, place, unnest([d1, d2]) AS dom FROM t) GROUP BY ALL),
        l AS (SELECT c_custkey, t.id, t.form = e.form AS fits FROM e JOIN t ON e.paper = t.paper AND e.eq IN (t.p_brand, t.p_type)),
        x AS (SELECT c_custkey, t.id FROM e JOIN t ON e.paper = t.paper AND e.form = t.form),
        s AS (SELECT e.c_custkey, (SELECT id FROM d WHERE d.paper = e.paper AND dom = ann) AS a, (SELECT id FROM d WHERE d.paper = e.paper AND dom = anchor) AS b,
          (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM l WHERE l.c_custkey = e.c_custkey) AS c, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM l WHERE l.c_custkey = e.c_custkey AND fits) AS f,
          (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM x WHERE x.c_custkey = e.c_custkey) AS g FROM e)
        SELECT c_custkey, coalesce(a, b, c, f, g) AS table_id, CASE WHEN a IS NOT NULL THEN 'annotation_id' WHEN b IS NOT NULL THEN 'audit_anchor_id' WHEN c IS NOT NULL THEN 'visible_label' WHEN f IS NOT NULL THEN 'visible_label_and_latex' WHEN g IS NOT NULL THEN 'exact_latex' ELSE 'unresolved' END AS match_method FROM s""",
    "dedupe_first": "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, lower(text)",
    "hash_split": """SELECT source, CASE WHEN r < t THEN 'train' WHEN r < least(n - 1, t + greatest(1, round_even(n * 0.1, 0))) THEN 'validation' ELSE 'test' END AS split FROM (
        SELECT source, row_number() OVER (ORDER BY sha256('7:' || source)) - 1 AS r, count(*) OVER () AS n, round_even(count(*) OVER () * 0.8, 0) AS t FROM (SELECT DISTINCT source FROM documents))""",
    "stratified_sample": "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS rank FROM documents) WHERE rank <= 5",
    "priority_cascade": """WITH n AS (SELECT c_custkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS t FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100) GROUP BY c_custkey)
        SELECT c_custkey, coalesce(s_suppkey, t) AS target, CASE WHEN s_suppkey IS NOT NULL THEN 'key' WHEN t IS NOT NULL THEN 'nation_balance' ELSE 'unresolved' END AS match_method
        FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN (SELECT c_custkey, t FROM n WHERE n = 1) USING (c_custkey)""",
}
