"""Every query of the library with an SQL equivalent, compared with DuckDB on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flipside.oracles import ORACLES  # noqa: E402
from flipside.queries import QUERIES  # noqa: E402

TABLES = ("documents", "labels", "pages", "conversations")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


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
    got = ordered([tuple(plain(r[c]) for c in columns) for r in frame.collect()])
    assert got == ordered([tuple(plain(v) for v in row) for row in want.fetchall()])
