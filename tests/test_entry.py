import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert df.columns == m.entry(spark).columns  # stable schema
    qs, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())
