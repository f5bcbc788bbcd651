"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"factor_library", "ensemble_holdout", "pipeline"}
OWN = sorted(n for n in registry.queries() if n not in SLOW and not n.startswith("op"))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows and any(v != "None" for r in rows for v in r)
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {listed} FROM ({sql})").fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
