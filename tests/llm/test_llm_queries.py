"""Registered queries of the subpackage against their SQL."""

import duckdb
import pytest

from tarifflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = QUERIES[name](spark, DATA), connection.execute(ORACLES[name])
    columns = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall())
