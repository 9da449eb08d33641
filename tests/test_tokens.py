"""Features made on the dimensions' rows are those that the order items' own text gives."""

from riskloom import names as N
from riskloom.operators import gold
from riskloom.plans.orders import TOKENS, silver

PARTS = ("product", "customer", "place")


def test_features_from_dimensions_are_those_of_the_rows(spark, sf):
    own, carried = (gold.gold_from_silver(silver(spark, sf, *parts), N.PROFIT) for parts in (PARTS, (*PARTS, "tokens")))
    assert own.columns == carried.columns
    assert own.exceptAll(carried).isEmpty() and carried.exceptAll(own).isEmpty()
    assert own.count() == carried.count() > 0


def test_tokens_of_dimensions_are_made_before_they_are_joined(spark, sf):
    rows = gold.gold_from_silver(silver(spark, sf, *PARTS, "tokens"), N.LATE).select(*TOKENS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Above the first join of the plan nothing is put together from text any more.
    above = plan[:next(i for i, line in enumerate(plan) if "Join" in line)]
    assert not any("regexp_replace" in line for line in above)
