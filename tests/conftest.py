from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hirelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate a column on a single row with one text column `t`."""

    def value(column, text=None, ddl="t string"):
        return spark.createDataFrame([(text,)], ddl).select(column.alias("v")).first()["v"]

    return value
