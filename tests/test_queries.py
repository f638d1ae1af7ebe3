"""Every query against its SQL in another engine, and a stable schema for the rest."""

import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OURS = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", OURS)
def test_query(spark, sf, duck, name):
    found = __spark_entry__.queries()[name](spark, sf).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns)
    else:
        assert rows(found) == rows(duck.sql(sql).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
