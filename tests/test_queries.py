"""Every query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quernstone.plans import COVERS, ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


def table(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    found = table(df.columns, df.collect())
    assert COVERS[name]
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert found == table(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "bm25", "keyword", "rank"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
