"""Alternatives come as lists of groups: the products and their candidates are not paired and dealt out by product."""

import pytest

from shelfwise import catalog_queries, entity_queries  # noqa: F401  (they register their queries)


@pytest.mark.parametrize("name", ["alternatives_by_price", "alternatives_by_quality", "alternatives_top3", "alternatives_top3_all"])
def test_products_are_not_dealt_out_by_themselves(spark, name):
    plan = catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "Window [row_number() windowspecdefinition(id#" not in plan
