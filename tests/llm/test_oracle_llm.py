"""Registered queries of footgrid.llm against their SQL."""

import os

import pytest
from oracle import compare

from footgrid.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == []
