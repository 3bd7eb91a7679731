"""The registered operator queries whose rows SQL can give, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from moodmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
