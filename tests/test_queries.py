"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from graphloom.plans import registry
from tests.oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose answer may be empty on the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) or name in EMPTY


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
