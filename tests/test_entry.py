"""The entry point, and each query with SQL against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from gradus.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if sql := catalogue.ORACLES.get(name):
        rel = duck.sql(sql)
        at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert sorted(rel.columns) == sorted(df.columns)
        want = [tuple(cell(r[i]) for i in at) for r in rel.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
