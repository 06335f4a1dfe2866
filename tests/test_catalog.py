"""Every registered query against its SQL on the smallest sample tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
# The league's own queries; those of the optional text part are tested in a folder of their own.
QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    types = {c[0]: str(c[1]) for c in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    order = [list(types).index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    assert got == expected


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["Year", "Team", "Stat", "Value", "Rank"] and df.count() > 0
