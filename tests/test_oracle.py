"""Every registered query against its DuckDB oracle (sf0.001; the driver
re-checks at sf0.01), and every rows-only query runs to completion."""

import pytest

from conftest import SF001
from kgflow.plans.catalog import CATALOG
from kgflow.plans.check import compare

SQL = sorted(k for k, (_, s) in CATALOG.items() if s)
ROWS = sorted(k for k, (_, s) in CATALOG.items() if not s)


@pytest.mark.parametrize("name", SQL)
def test_matches_oracle(spark, duck001, name):
    fn, sql = CATALOG[name]
    r = compare(spark, SF001, fn, sql, duck001)
    assert r["schema"], (r["spark_cols"], r["oracle_cols"])
    assert r["values"], r["diff"]


@pytest.mark.parametrize("name", ROWS)
def test_rows_only_runs(spark, name):
    fn, _ = CATALOG[name]
    rows = fn(spark, SF001).collect()
    assert len(rows) > 0
