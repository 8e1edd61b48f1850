import importlib
import sys

from pyspark.sql import DataFrame


def test_entry(spark, small):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert isinstance(df, DataFrame) and df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as e

    import postloom

    for name in [m for m in sys.modules if m.startswith("postloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(postloom, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "postloom.llm", None)
    try:
        again = importlib.reload(e)
        assert "trend_top" in again.queries() and not any(k.startswith("p4") for k in again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
