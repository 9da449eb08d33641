"""What a fit reads several times is worked out once."""

from riskloom import names as N
from riskloom.plans import orders, q_model_checks

SMALLEST = "/root/testdata/sf0.001"


def test_signals_of_a_fit_are_joined_once(spark):
    rows = q_model_checks._signals(spark, SMALLEST, N.PROFIT)
    assert "Join" not in rows._jdf.queryExecution().analyzed().toString()
    assert rows.count() == orders.silver(spark, SMALLEST).count()
