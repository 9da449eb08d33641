"""A profile makes of a value once what it needs, and parses only what may be a time."""

from pyspark.sql import functions as F

from riskloom.operators import profiling as P


def test_text_is_parsed_as_time_only_where_it_can_be_one(spark):
    texts = ["2024-02-29", "2024-02-29 07:08:09", " 2024-02-29 ", "2024-2-3", "2024", "2/29/2024", "2/29/2024 7:08", "A", "", "  ", "A-B", "12", "2/30/2024",
             "1/2", "x/1", None, "2024-02-30", "-5", "+012024-01-01", "2024-02-29T07:08:09.5", "T12", "12:30", "2024-02-29 07:08:09+01:00", "1-1-1"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    tried = F.coalesce(F.col("t").try_cast("timestamp_ntz"), *[
        F.try_to_timestamp("t", F.lit(p)).cast("timestamp_ntz") for p in P.TIMESTAMP_PATTERNS])
    rows = df.select("t", P._as_timestamp(F.col("t")).cast("string").alias("a"), tried.cast("string").alias("b")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]
    assert sum(r.a is not None for r in rows) >= 6
    assert "RLIKE" in str(P._as_timestamp(F.col("t"))).upper()


def test_sketched_profile_makes_of_a_value_what_the_exact_one_does(spark):
    df = spark.createDataFrame(
        [(float(i) if i % 7 else None, "" if i % 5 == 0 else "AB"[i % 2], f"2024-01-{i % 28 + 1:02d}" if i % 3 else " ", float("nan") if i % 4 == 0 else 1.0)
         for i in range(200)], "x DOUBLE, flag STRING, day STRING, odd DOUBLE").withColumn("at", F.col("day").try_cast("date"))
    same = ["variable_name", "status", "row_count", "missing_rate", "summary_min", "summary_max", "first_timestamp", "last_timestamp"]
    key = lambda d: sorted(map(str, d.select(*same).collect()))
    assert key(P.sketched_profile(df)) == key(P.profile(df))
