import pytest

from fieldfold.llm import queries

from ..oracle import compare


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)
