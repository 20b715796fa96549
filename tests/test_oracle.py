"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from docweave.plans import export_queries, more_queries, policy_queries, record_queries, relational_queries, retrieval_queries, text_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for m in (retrieval_queries, text_queries, record_queries, relational_queries, export_queries, more_queries, policy_queries) for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'").fetchall()
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    f, sql = QUERIES[name]
    df = f(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "ordinal"]
    assert df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
