import pytest

from tamis.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert same(spark, connect(sf), sf, QUERIES[name], ORACLE[name]) > 0
