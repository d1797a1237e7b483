"""Every query that has SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, small, name):
    df, want = entry.queries()[name](spark, small), duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert len(got) == len(rows) and all(same(x, y) for a, b in zip(got, rows) for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
