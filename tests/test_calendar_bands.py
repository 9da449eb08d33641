import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import bands, calendar


def test_iso_week_key_and_weekday_numbers(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 1, 1, 5),)], "t TIMESTAMP")
    row = df.select(calendar.week_key("t").alias("w"), calendar.day_key("t").alias("d"), calendar.week_start("t").alias("m"),
                    *[e.alias(n) for n, e in calendar.order_time_columns("t").items()]).first()
    assert (row["w"], row["d"], row["m"]) == ("2016-W52", 20170101, dt.date(2016, 12, 26))
    assert row["order_day_of_week"] == 1 and row["order_is_weekend"] == 1 and row["order_season"] == "winter" and row["order_hour"] == 5


def test_unknown_time_falls_through(spark):
    row = spark.createDataFrame([(None,)], "t TIMESTAMP").select(
        *[e.alias(n) for n, e in calendar.order_time_columns("t").items()]).first()
    assert row["order_season"] == "fall" and row["order_is_weekend"] == 0 and row["order_year"] is None


def test_calendar_dimension(spark):
    dim = calendar.calendar_dim(spark)
    assert dim.count() == 1461
    row = dim.where("date = '2017-01-02'").first()
    assert (row["week_number"], row["day_of_week_number"], row["week_start"]) == (2, 1, dt.date(2017, 1, 2))
    assert dim.where("date = '2017-01-01'").first()["week_number"] == 1


def test_delivery_flags(spark):
    df = spark.createDataFrame([(3, 3), (5, 3), (None, 3)], "a INT, s INT")
    got = [tuple(r) for r in df.select(*calendar.delivery_columns("a", "s").values()).collect()]
    assert got == [(0.0, 1, 1, 0), (2.0, 1, 0, 1), (None, 0, 0, 0)]


def test_band_edges_and_missing(spark):
    df = spark.createDataFrame([(-0.01,), (0.0,), (9.99,), (10.0,), (100.0,), (None,)], "v DOUBLE")
    got = [r[0] for r in df.select(bands.profit_band("v")).collect()]
    assert got == ["Negative Profit", "$0 - $10", "$0 - $10", "$10 - $25", "$100+", "$100+"]
    df = spark.createDataFrame([(0.3499,), (0.35,), (0.65,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(bands.risk_band("v")).collect()] == ["Low Risk", "Medium Risk", "High Risk", "High Risk"]


def test_calibration_bins_are_right_closed(spark):
    values = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 0.7, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(bands.calibration_label(bands.calibration_bin("v"))).collect()]
    assert got == ["(-0.001, 0.1]", "(-0.001, 0.1]", "(0.1, 0.2]", "(0.2, 0.3]", "(0.3, 0.4]", "(0.6, 0.7]", "(0.8, 0.9]", "(0.9, 1.0]"]


def test_rank_in_rest(spark):
    df = spark.createDataFrame([("b",), ("zz",), (None,)], "v STRING")
    assert [r[0] for r in df.select(bands.rank_in(F.col("v"), ["a", "b"])).collect()] == [2, 99, 99]
