"""The registered text queries against their SQL, on the smallest sample tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from leaguestats.llm.oracles import ORACLES
from leaguestats.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(entry_module.oracle_sql())
    assert {int(name.split("_")[0].removeprefix("op")) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op11_phrase_parsing"}))  # that one has phrases to find in larger tables only
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    expected = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr) == expected and expected
