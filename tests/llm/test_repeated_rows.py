"""Repeated passages where rows are repeated, or share an id but not the text."""

from __future__ import annotations

from inkwell.llm import substring
from tests.llm.test_operators import passage

SHARED = passage(1, 80)
FIRST, SECOND = passage(10, 50) + " " + SHARED + " " + passage(40, 50), passage(11, 50) + " " + SHARED + " " + passage(41, 50)


def found(spark, rows):
    return [r.asDict() for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]


def test_a_repeated_row_hides_nothing(spark):
    once = sorted(found(spark, [(1, FIRST), (2, SECOND)]), key=repr)
    assert [r["doc_id"] for r in once] == [1, 2] and once[1]["n_removed_words"] >= 40
    assert sorted(found(spark, [(1, FIRST), (2, SECOND), (2, SECOND), (1, FIRST), (2, SECOND)]), key=repr) == once


def test_texts_that_share_an_id_are_cut_each_for_itself(spark):
    short = SHARED + " " + passage(77, 30)
    rows = [(1, FIRST), (2, SECOND), (2, short), (2, passage(78, 300)), (2, short)]
    out = substring.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = {r["text"] for t in (SECOND, short) for r in substring.remove_passages(spark.createDataFrame([(1, FIRST), (2, t)], "doc_id long, text string")).collect() if r["doc_id"] == 2}
    assert {r["text"] for r in out if r["doc_id"] == 2} == alone | {passage(78, 300)} and len(out) == 5
    assert {r["text"] for r in out if r["doc_id"] == 1} == {FIRST} and SECOND not in alone and short not in alone
