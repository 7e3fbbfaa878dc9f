import pytest
from oracle import differences

from evidex.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    rows, found = differences(spark, name, catalogue.queries()[name], SQL[name], SF)
    assert not found, found


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(e.queries())
