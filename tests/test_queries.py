"""Every query with SQL gives what DuckDB gives; the others run."""

import duckdb
import pytest

from conftest import DATA
from quillstack.plans.queries import QUERIES, SQL

TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        at = [[d[0] for d in result.description].index(c) for c in columns]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
