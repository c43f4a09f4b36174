"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from graphloom.llm import registry, sql
from tests.oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


SQL = registry.oracle_sql() | sql.TESTED


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF), connect(SF), SQL[name])
