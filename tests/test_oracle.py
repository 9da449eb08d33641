"""Every registered query with reference SQL, compared on the smallest data."""

import pytest

import check
from riskloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def duck(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_reference_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert check.compare(got, duck.execute(registry.ORACLES[name]).df()) is None


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "ao3_priority_segment"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
