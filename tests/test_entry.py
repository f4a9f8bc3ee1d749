import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import queries, run_queries

QUERIES, ORACLE_SQL = queries.QUERIES | run_queries.QUERIES, queries.ORACLE_SQL | run_queries.ORACLE_SQL


def comparable(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert sorted(repr(tuple(comparable(r[i]) for i in order)) for r in rows) == sorted(repr(tuple(map(comparable, r))) for r in cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
