"""Plan-shape guarantees over every registered batch job."""

import pytest

from conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as e

    return {name: _plan(fn(spark, SF)) for name, fn in sorted(e.queries().items()) if not name.startswith("st_")}


def test_no_cross_products(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_topk_and_limits_shapes(plans):
    assert "FlatMapCoGroupsInPandas" in plans["cosine_topk"]
    for name in ("first_n_per_group", "eval_items", "cosine_topk"):
        assert "WindowGroupLimit" in plans[name], name
