"""Quality rules by host, in DataFrame operations only.

Every document gets its own counts in one pass over its text: words, symbols, repeated lines, words in repeated
8-word windows. Documents that break a rule are counted by host, the hosts' failure rates are shrunk towards the
corpus with a beta prior fitted to the hosts themselves (method of moments), and a host whose shrunken rate is
above `host_limit` is suspect. The verdict joins that back: a document is rejected if it breaks a base rule, if it
collects `own_limit` points from the softer rules by itself, or if it has a point and its host is suspect. A document
that breaks no rule is always kept, whatever its host.

Hosts may hold any share of the rows: counts are combined before the shuffle, and the join back is an equi-join
of narrow rows whose hot host adaptive execution splits. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import let
from inkwell.scratch import materialize

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words which the same array holds twice or more.

    Windows are compared by 64-bit hash of their words' hashes. Sorting (hash, place) brings equal windows
    together, so the cost is n log n in the words of one document, repeated or not.
    """
    place = lambda p: p.getField("i")

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def twins(ranked: Column) -> Column:
        """Places whose window's neighbour in rank is the same window."""
        n = F.size(ranked)
        same = F.zip_with(F.slice(ranked, F.lit(1), n - 1), F.slice(ranked, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"])
        return let(same, lambda eq: F.array_sort(F.transform(F.filter(ranked, lambda s, i: F.coalesce(F.get(eq, i), F.lit(False)) | F.coalesce(F.get(eq, i - 1), F.lit(False))), place)))

    def of(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ranked, lambda r: let(twins(r), covered)))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of))


def document_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", held: bool = False) -> DataFrame:
    """doc_id, host and the counts of each document, and with `held` its whole row as a struct of that name.

    A null text has no words; a null host is a host of its own.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")] if held else []
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *row)
    words = F.array_remove(F.split("body", SPACE), "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(NOT_SPACE))
    row = ["held"] if held else []
    split = plain.select("doc_id", "host", *row, "body", words.alias("words"), lines.alias("lines"))
    without = lambda chars: F.length(F.translate("body", chars, ""))
    return split.select(
        "doc_id",
        "host",
        *row,
        F.size("words").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("body") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def host_verdicts(metrics: DataFrame, host_limit: float = 0.3) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunken), host_failed, for rows with `host` and a boolean `failed`.

    The prior has the mean and variance of the hosts' raw rates; where there is no variance to fit (one host, or
    all alike) it has the strength of ten documents.
    """
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(rate), F.coalesce(F.var_pop(rate), F.lit(0.0))).first()
    mean = mean or 0.0
    strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread and spread > 1e-9 else 10.0
    shrunk = (F.col("n_failed") + F.lit(mean) * F.lit(strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > host_limit).alias("host_failed"))


def judge(metrics: DataFrame, symbol_percent: int = 30, dup_line_percent: int = 30, word_length: tuple[int, int] = (2, 15)) -> DataFrame:
    """Metrics with base_failed, n_soft and failed, each from the document alone."""
    n = F.col("n_words")
    soft = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    return (
        metrics.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))
        .withColumn(
            "n_soft",
            2 * soft(100 * F.col("n_symbols") > symbol_percent * n)
            + soft(100 * F.col("n_dup_lines") > dup_line_percent * F.col("n_lines"))
            + soft((F.col("word_chars") < word_length[0] * n) | (F.col("word_chars") > word_length[1] * n)),
        )
        .withColumn("failed", F.col("base_failed") | (F.col("n_soft") > 0))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.3, own_limit: int = 2, **limits) -> DataFrame:
    """One row per document: its counts, base_failed, n_soft, host_failed, kept.

    Base rules: fewer than 20 words; more than 30 % of the words in repeated windows. Soft rules: more symbols
    than symbol_percent of the words (two points); more than dup_line_percent of the lines repeat an earlier one;
    a mean word length outside word_length (a point each). Null and empty texts have no words and fail; texts may be
    as long as a cell can be. Repeated rows are judged one by one; other columns, whatever their names, are not read;
    an empty table gives an empty result.
    """
    judged = materialize(judge(document_metrics(docs, id_col, text_col, host_col), **limits), "quality")
    hosts = host_verdicts(judged, host_limit).select(F.col("host").alias("of_host"), "host_failed")
    kept = ~F.col("base_failed") & (F.col("n_soft") < own_limit) & ~((F.col("n_soft") > 0) & F.col("host_failed"))
    return judged.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host", "failed").withColumn("kept", kept)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.3, own_limit: int = 2, **limits) -> DataFrame:
    """The rows of `docs` that quality_rules() keeps, with their columns.

    Each row is judged by itself, ids play no part. Only rows whose host decides are joined with the hosts: the others
    are not shuffled at all.
    """
    judged = materialize(judge(document_metrics(docs, id_col, text_col, host_col, held=True), **limits).select("held", "host", "base_failed", "n_soft", "failed"), "judged")
    good = host_verdicts(judged, host_limit).filter(~F.col("host_failed")).select(F.col("host").alias("of_host"))
    clean = judged.filter("not base_failed and n_soft = 0")
    doubtful = judged.filter(f"not base_failed and n_soft > 0 and n_soft < {int(own_limit)}").join(good, F.col("host").eqNullSafe(F.col("of_host")), "left_semi")
    return clean.unionByName(doubtful).select("held.*")
