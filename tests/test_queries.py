"""Every query of the catalog against its SQL, and the entry points."""

import importlib
import math
import sys
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v.normalize()) if isinstance(v, Decimal) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry(spark):
    assert set(QUERIES) == set(ORACLE_SQL)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_imports_without_the_corpus_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tidemark.llm")] + ["tidemark.llm"]:
        monkeypatch.setitem(sys.modules, name, None)
    fresh = importlib.reload(entry)
    try:
        assert set(fresh.queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
