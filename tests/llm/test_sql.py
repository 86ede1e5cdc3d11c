"""Every query of this package with an SQL equivalent, compared with DuckDB on small tables."""

import duckdb
import pytest

from flipside.llm.oracles import ORACLES
from flipside.llm.queries import QUERIES

TABLES = ("documents", "labels", "pages", "benchmark", "conversations", "embeddings")


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, duck, name):
    frame = QUERIES[name](spark, folder)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
