"""Every registered query of the evaluation engine against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
import duelgrid.queries_inputs  # noqa: F401
from duelgrid.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(v):
    return [normal(x) for x in v] if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([normal(r[c]) for c in columns] for r in df.collect())
    assert got
    if name in SQL:
        r = duck.sql(SQL[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert sorted([normal(x[k]) for k in at] for x in r.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
