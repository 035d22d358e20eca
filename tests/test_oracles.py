"""Every registered query of the retrieval engine against its SQL, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = tables.sql(ORACLES[name])
    assert columns == sorted(expected.columns)
    at = [list(expected.columns).index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in expected.fetchall()), key=repr)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
