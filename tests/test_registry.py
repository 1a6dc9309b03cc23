import pytest

from tamis.plans.registry import ORACLE, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    same(spark, connect(sf), sf, QUERIES[name], ORACLE[name])


def test_entry_and_driver_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
