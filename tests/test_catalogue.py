"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from auditmill.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows):
    return sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert plain([[r[c] for c in cols] for r in df.collect()]) == plain([[r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
