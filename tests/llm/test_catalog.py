import pytest
from support import agrees

from tessel.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    agrees(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)]
