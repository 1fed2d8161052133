import pytest

pytest.importorskip("public_tokenizers")

from logloom.llm import queries

from tests.helpers import DATA, compare_with_sql


def test_every_query_equals_its_sql(spark):
    assert compare_with_sql(spark, queries.QUERIES, queries.ORACLE) == []


def test_queries_without_sql_run(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in set(queries.QUERIES) - set(queries.ORACLE):
        n = queries.QUERIES[name](spark, DATA).count()
        assert n >= documents if name in ("p6_ids", "p7_pack", "p8_levels") else n > 0 or name == "p8_found", name
