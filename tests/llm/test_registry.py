import pytest

from contentwatch.llm import registry
from tests.test_oracles import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", ["op2_chat"])
def test_query_equals_its_sql(spark, duck, small_tables, name):  # noqa: F811
    compare(spark, duck, registry.queries()[name], registry.oracle_sql()[name], small_tables)
