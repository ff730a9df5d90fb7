"""Every registered query of the engine against its SQL on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__
from joulegrid import registry
from tests.conftest import DATA


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: float(v) if isinstance(v, float) else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    cursor = oracle.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.columns, df.collect()) == plain(columns, cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
