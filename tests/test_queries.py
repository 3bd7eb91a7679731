"""Every query with an SQL counterpart, on the smallest tables; model queries by shape."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from moodmill import plans

SF = "/root/testdata/sf0.001"
SLOW = ("eval_1", "eval_2", "sel_07", "ml_0", "ml_1", "udf_0", "snk_07", "txt_35_feature_blocks_all")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) is None


@pytest.mark.parametrize(
    "name", sorted(n for n in plans.QUERIES if n not in plans.ORACLES and not n.startswith(SLOW))
)
def test_query_yields_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["ml_05_multinomial_nb", "eval_14_compare_models"])
def test_models(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    assert rows
    for row in rows:
        assert 0 <= row["f" if "f" in row else "mean"] <= 1
