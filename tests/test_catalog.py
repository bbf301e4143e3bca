"""Every registered query against its SQL statement, and what its plan must not hold."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from check import TABLES, row_bag
from hirelens.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no shared tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    result = duck.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert row_bag(frame.columns, frame.collect()) == row_bag(names, result.fetchall())


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
