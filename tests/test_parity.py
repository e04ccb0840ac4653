"""Every registered query with a SQL twin gives the same rows as the twin in another engine."""

import os

import duckdb
import pytest

from labelmill.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, engine, name):
    df = registry.QUERIES[name](spark, DATA)
    want = engine.execute(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in want.description)
    index = [[c[0] for c in want.description].index(c) for c in columns]
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    expect = sorted((tuple(r[i] for i in index) for r in want.fetchall()), key=key)
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        for x, y in zip(g, e):
            assert x == y or (isinstance(x, float) and abs(x - y) < 2e-6), (name, g, e)


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, DATA).count() > 0, name
