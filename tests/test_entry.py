import __spark_entry__ as e
from planmill.queries.catalog import QUERIES


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["plan_id", "tokens", "n_tokens"] and df.limit(5).count() == 5


def test_registry():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q) and len(QUERIES) > 90
