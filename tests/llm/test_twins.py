"""The registered queries that have a twin in SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from webloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    want = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(want.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == rows and rows
