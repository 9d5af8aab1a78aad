"""Registered queries against their SQL."""

import datetime as dt
import decimal
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tarifflow.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (dt.date, dt.datetime, pd.Timestamp)):
        return str(value)[:10]
    if isinstance(value, (str, bool)) or "bool" in str(type(value)):
        return value if isinstance(value, str) else bool(value)
    if isinstance(value, (int, float, decimal.Decimal)) or hasattr(value, "item"):
        return round(float(value), 6)
    return list(value)


def rows(frame):
    return sorted(repr([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_whole_raw_content_keeps_what_the_reference_keeps(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect()}
    got = {r["doc_id"]: r["raw_content"] for r in QUERIES["whole_raw_content"](spark, DATA).collect()}
    assert max(t.count("\n") for t in texts.values()) >= 5
    assert got == {k: "\n".join(t.split("\n")[:3000]) for k, t in texts.items()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
