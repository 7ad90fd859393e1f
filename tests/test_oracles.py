"""Every query with a SQL twin must agree with it on whole tables."""

import os

import pytest

from tests.oracle import compare, connect
from tidewright.plans import catalog

PATH = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    status, rows, _, note = compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES[name], PATH)
    assert status == "ok", note
