"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from factloom import registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v)

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted(([one(v) for v in r] for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_generation_knows_what_was_replaced_whatever_the_key(spark, tmp_path):
    """An order with key 0, of which a minus says nothing, in the shard that is replaced."""
    columns = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"
    spark.createDataFrame([(0, 2, 5.0, "a"), (1, 10, 5.0, "a"), (2, 3, -5.0, "a"), (3, 5, 5.0, "a")], columns).write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in registry.QUERIES["ledger_generation"](spark, str(tmp_path)).collect()}
    want = duckdb.sql(registry.ORACLE_SQL["ledger_generation"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert got == set(want)
