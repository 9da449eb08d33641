import pytest
from pyspark.sql import functions as F

from riskloom import names as N
from riskloom.operators import gold


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, ids):
    return spark.createDataFrame([(i, None if i == 7 else i) for i in ids], "a LONG, b LONG")


def test_key_diff_counts_repeats_and_parts_nulls(spark):
    left, right = rows(spark, [1, 2, 2, 3, 3, 7]), rows(spark, [3, 4, 4, 7, 7])
    got = sorted((r["a"], r["side"]) for r in gold.key_diff(left, right, ["a", "b"]).collect())
    anti = [(r["a"], "missing") for r in left.join(right, ["a", "b"], "left_anti").collect()]
    anti += [(r["a"], "unexpected") for r in right.join(left, ["a", "b"], "left_anti").collect()]
    assert got == sorted(anti) and len(got) == 8
    assert gold.key_diff(left.limit(0), right.limit(0), ["a", "b"]).count() == 0


def test_bucketed_tables_meet_without_a_shuffle(spark, no_broadcast):
    base = spark.range(1000).select(*[F.col("id").cast("int").alias(k) for k in N.KEYS], (F.col("id") % 5).alias("v"))
    one, two, three = (gold.store_by_keys(base.withColumnRenamed("v", n), n) for n in ("x", "y", "z"))
    keys = list(N.KEYS)
    joined = one.join(two, keys).join(three, keys)
    assert "Exchange" not in plan(joined) and joined.where("x = y and y = z").count() == 1000
    enriched = gold.enrich_left(one, (two, ["y"]), (three, ["z"]))
    assert "Exchange" not in plan(enriched) and enriched.count() == 1000
    diff = gold.key_diff(one, two.where("y > 1"))
    assert "Exchange" not in plan(diff) and diff.count() == 400
    merged = gold.merge_one_to_one(one, two, check=False)
    assert "Exchange" not in plan(merged) and merged.count() == 1000
    plain = base.join(base.withColumnRenamed("v", "w"), keys)
    assert "Exchange" in plan(plain)  # what buckets save


def test_lines_are_joined_before_anything_is_derived(spark, sf):
    from riskloom.plans.orders import silver

    rows = silver(spark, sf, "product", "customer", "place").select(*N.KEYS, "Delivery_Status", "Category_Name", "Customer_Segment", "Order_City")
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    derived = [i for i, line in enumerate(plan) if N.CANCELLED_DELIVERY in line]
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert derived and joins and max(derived) < min(joins)


def test_split_labels_read_their_input_once(spark, sf):
    from riskloom.operators import split
    from riskloom.plans.orders import silver

    out = split.label_split(silver(spark, sf).select(*N.KEYS))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["e1_gold_late_joined", "e1_gold_late_bucketed"])
def test_feature_tables_are_made_from_rows_that_are_dealt_once(spark, sf, no_broadcast, name):
    from riskloom.plans import registry

    registry.load()
    out = registry.QUERIES[name](spark, sf)
    assert "hashpartitioning" not in plan(out) and "lineitem" not in plan(out)
