import pytest
from oracle import same

from wardline.plans import all_queries

WITH_SQL = [k for k, (_, sql) in all_queries.QUERIES.items() if sql]
WITHOUT = [k for k, (_, sql) in all_queries.QUERIES.items() if not sql]
SLOW = {"component_model", "model_importances"}  # test_models_plain.py fits them on a smaller table


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    query, sql = all_queries.QUERIES[name]
    same(spark, query, sql, sf_dir)


@pytest.mark.parametrize("name", [k for k in WITHOUT if k not in SLOW])
def test_query_gives_rows(spark, sf_dir, name):
    assert all_queries.QUERIES[name][0](spark, sf_dir).count() > 0
