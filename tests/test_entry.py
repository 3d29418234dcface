"""The driver contract."""

import importlib.util
import os

from conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.columns == ["x", "arg0"]
    assert len(df.collect()) >= 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
