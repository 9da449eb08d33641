"""Training-data queries against their reference SQL on the smallest data."""

import pytest

import check
from riskloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_reference_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert check.compare(got, check.duck(sf).execute(queries.ORACLES[name]).df()) is None


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
