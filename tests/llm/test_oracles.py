"""Queries that SQL can express, against DuckDB on whole tables; and the contract's registration."""

import duckdb
import pytest

import __spark_entry__ as contract
from salesloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_contract_has_all():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
