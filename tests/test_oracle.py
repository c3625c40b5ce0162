"""Every registered query with a SQL counterpart gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from lumiframe.catalog import all_queries

QUERIES, ORACLES = all_queries()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted([normal(r[columns.index(c)]) for c in order] for r in cursor.fetchall())
    found = sorted([normal(r[c]) for c in order] for r in df.collect())
    assert found == expected
