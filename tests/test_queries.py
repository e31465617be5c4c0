"""Every query against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from inkwell.plans import papers, search, tables

QUERIES = {n: q for p in (search, tables, papers) for n, q in p.QUERIES.items()}
SQL = {n: s for p in (search, tables, papers) for n, s in p.ORACLE_SQL.items()}


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 5)
    return x.item() if hasattr(x, "item") else x


def rows(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    found = [r.asDict() for r in got.collect()]
    if name not in SQL:
        assert found
        return
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(found, columns) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "doc_id", "rank", "score"]
