import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import measures, profiling, sketches


def test_error_of_every_size_is_within_bounds(spark):
    sizes = [0, 1, 2, 50, 1000, 20_000, 60_000]
    rows = spark.range(sum(3 * n for n in sizes)).repartition(9)
    edges = np.cumsum([0, *[3 * n for n in sizes]]).tolist()
    size, start = F.lit(None), F.lit(None)
    for n, a in zip(sizes[::-1], edges[:-1][::-1]):
        if n:
            size, start = F.when(F.col("id") >= a, F.coalesce(size, F.lit(n))).otherwise(size), F.when(F.col("id") >= a, F.coalesce(start, F.lit(a))).otherwise(start)
    rows = rows.select(size.alias("n"), F.concat(F.lit("v"), (F.col("id") - start) % size).alias("v"))
    for precision in (10, 14):
        got = sketches.estimates(sketches.distinct_sketches(rows, ["v"], ["n"], precision), precision).collect()
        assert {r["n"] for r in got} == set(sizes) - {0}
        for r in got:
            assert r["row_count"] == 3 * r["n"] and r["distinct_lower"] <= r["n"] <= r["distinct_upper"]
            assert abs(r["distinct_values"] - r["n"]) <= 3 * sketches.relative_error(precision) * r["n"]


def test_nulls_empty_text_other_types_and_no_rows(spark):
    rows = spark.createDataFrame([("", 1.5, None), (None, None, None), ("a", -0.0, None), ("a", 0.0, None)], "s STRING, d DOUBLE, x DATE")
    got = {r["column_name"]: r["distinct_values"] for r in sketches.estimated_cardinality(rows, ["s", "d", "x"]).collect()}
    assert got == {"s": 2, "d": 2, "x": 0}
    none = sketches.estimated_cardinality(rows.where("false"), ["s"]).collect()
    assert [tuple(r) for r in none] == [("s", 0, 0, 0)]
    assert sketches.distinct_sketches(rows.where("false"), ["s"], ["d"]).count() == 0
    with pytest.raises(ValueError, match="row_count"):
        sketches.distinct_sketches(rows.withColumn("row_count", F.lit(1)), ["s"], ["row_count"])
    with pytest.raises(ValueError, match="precision"):
        sketches.estimated_cardinality(rows, ["s"], precision=3)


@pytest.fixture
def visits():
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 2, 20) + dt.timedelta(int(d)) for d in rng.integers(0, 20, 3000)]
    return [(d, int(c), "ab"[int(c) % 2]) for d, c in zip(days, rng.integers(0, 400, 3000)) if d.day != 25] + [(None, 1, "a")]


def test_days_merge_and_replace(spark, visits, tmp_path):
    path = f"{tmp_path}/daily"
    df = spark.createDataFrame(visits, "day DATE, customer INT, kind STRING")
    sketches.store_daily_sketches(df, F.col("day"), ["customer"], path, ["kind"])
    # Two days again, one of them with other rows: these days alone change.
    again = [(d, c + 10_000, k) for d, c, k in visits if d == dt.date(2024, 3, 1)] + [v for v in visits if v[0] == dt.date(2024, 3, 2)]
    sketches.store_daily_sketches(spark.createDataFrame(again, df.schema), F.col("day"), ["customer"], path, ["kind"])
    now = [v for v in visits if v[0] not in (dt.date(2024, 3, 1), dt.date(2024, 3, 2))] + again
    kept = sketches.read_daily_sketches(spark, path)
    whole = {r["kind"]: r for r in sketches.estimates(sketches.merge_sketches(kept, ["kind"])).collect()}
    for k in "ab":
        true = len({c for _, c, kind in now if kind == k})
        assert whole[k]["distinct_lower"] <= true <= whole[k]["distinct_upper"]
        assert whole[k]["row_count"] == sum(kind == k for _, _, kind in now)
    few = sketches.read_daily_sketches(spark, path, "2024-03-01", "2024-03-02")
    assert few.agg(F.sum("row_count")).first()[0] == len(again)
    assert "PartitionFilters: [isnotnull(sketch_day" in few._jdf.queryExecution().toString()


def test_rolling_counts_against_brute_force(spark, visits):
    df = spark.createDataFrame(visits, "day DATE, customer INT, kind STRING").withColumnRenamed("day", "sketch_day")
    daily = sketches.distinct_sketches(df, ["customer"], ["sketch_day"])
    got = {r["sketch_day"]: r for r in sketches.rolling_distinct(daily, 7).collect()}
    assert set(got) == {d for d, _, _ in visits if d}
    for day, r in got.items():
        held = [c for d, c, _ in visits if d and 0 <= (day - d).days < 7]
        assert r["row_count"] == len(held) and r["distinct_lower"] <= len(set(held)) <= r["distinct_upper"]


def test_sketched_profile_agrees_with_the_exact_one(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x) if i % 11 else None, f"{int(n)}" if i % 50 else "x", f"2020-01-{1 + i % 28:02d}" if i % 13 else None,
             None if i % 3 else "", dt.date(2021, 1, 1 + i % 9), float("nan") if i % 7 == 0 else 1.0)
            for i, (x, n) in enumerate(zip(rng.normal(0, 1, 900), rng.integers(0, 40, 900)))]
    df = spark.createDataFrame(rows, "x DOUBLE, code STRING, shipped STRING, blank STRING, day DATE, odd DOUBLE").withColumn("nothing", F.lit(None).cast("double"))
    exact = profiling.profile(df).toPandas().set_index("variable_name")
    got = profiling.sketched_profile(df).toPandas().set_index("variable_name").reindex(exact.index)
    assert list(got.columns) == list(exact.columns)
    for c in ("status", "row_count", "missing_rate", "summary_min", "summary_max", "first_timestamp", "last_timestamp", "high_missingness", "single_value"):
        assert got[c].astype(str).to_dict() == exact[c].astype(str).to_dict(), c
    assert (abs(got["unique_values"] - exact["unique_values"]) <= 3 * sketches.relative_error() * exact["unique_values"]).all()
    places = np.sort([r[0] for r in rows if r[0] is not None])
    for c, p in (("summary_q1", 0.25), ("summary_median", 0.5), ("summary_q3", 0.75)):
        assert abs(np.searchsorted(places, got.loc["x", c]) - p * len(places)) <= 2
    assert profiling.sketched_profile(df.where("false")).count() == 7


def test_sketched_geographic_counts(spark):
    cells = [(f"c{i % 5}", f"r{i % 9}", f"s{i}") for i in range(300)]
    df = spark.createDataFrame(cells, "map_location_country STRING, map_location_region STRING, map_location_state STRING")
    for c in ("order_item_count", "high_risk_order_count", "protect_high_value_at_risk_count", "expedite_selectively_count", "geo_coordinates_available"):
        df = df.withColumn(c, F.lit(1))
    df = df.withColumns({"total_predicted_profit": F.lit(1.0), "total_order_value": F.lit(2.0)})
    exact, got = (measures.geographic_kpis(df, precision=p).first().asDict() for p in (None, 14))
    assert {k for k in exact if exact[k] != got[k]} <= {"geo_states"} and abs(got["geo_states"] - 300) <= 3 * sketches.relative_error(14) * 300
