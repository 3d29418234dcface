"""Plan-shape checks: what the scale notes in README promise."""

import pytest

from conftest import SF001
from kgflow.plans.catalog import CATALOG


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_no_products(spark, name):
    plan = _plan(CATALOG[name][0](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_prefix_filter_reaches_scan(spark):
    plan = _plan(CATALOG["kg_label_prefix"][0](spark, SF001))
    assert "StringStartsWith(p_name,small)" in plan


def test_only_needed_tables_scanned(spark):
    plan = _plan(CATALOG["kg_three_hop"][0](spark, SF001))
    for t in ("nation.parquet", "customer.parquet", "supplier.parquet", "orders.parquet"):
        assert t in plan
    for t in ("lineitem.parquet", "part.parquet", "region.parquet"):
        assert t not in plan


def test_column_pruning(spark):
    plan = _plan(CATALOG["kg_three_hop"][0](spark, SF001))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
