import __spark_entry__ as entry
from logloom.plans import registry

from tests.helpers import DATA, compare_with_sql


def test_every_query_equals_its_sql(spark):
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert compare_with_sql(spark, queries, oracle) == []


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, DATA).count() > 0, name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "key_hex" and df.count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())
