import pytest

from tests.oracle import assert_same, connect
from tracemill.llm import base_queries, queries


@pytest.mark.parametrize("name", sorted(base_queries.SQL))
def test_fixed_columns_equal_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name])
