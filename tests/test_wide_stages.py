"""Wide projections are compiled in parts."""

from riskloom.plans import orders
from riskloom.session import METHOD_CONF

SMALLEST = "/root/testdata/sf0.001"


def test_wide_stages_are_compiled_in_parts_unless_the_session_says_how(spark):
    spark.conf.unset(METHOD_CONF)
    orders.silver(spark, SMALLEST)
    assert spark.conf.get(METHOD_CONF) == "8000"
    spark.conf.set(METHOD_CONF, 65535)
    orders.silver(spark, SMALLEST)
    assert spark.conf.get(METHOD_CONF) == "65535"
    spark.conf.unset(METHOD_CONF)
