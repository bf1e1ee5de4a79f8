"""Every query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lemmalake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cur = con.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == columns
    assert got == sorted(repr([plain(r[at[c]]) for c in columns]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
