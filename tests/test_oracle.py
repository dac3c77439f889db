"""Every query with an SQL counterpart gives the same rows."""

from __future__ import annotations

import pathlib

import pytest

from sensorloom.plans import catalog

from .compare import connect, mismatch

SF = "/root/testdata/sf0.01"
catalog.load()


@pytest.fixture(scope="module")
def con():
    if not pathlib.Path(SF).exists():
        pytest.skip("test tables are not here")
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    msg = mismatch(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])
    assert msg is None, msg
