import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cleaning
from riskloom.session import materialize, shared_folder
from riskloom.sources import files, publish


@pytest.fixture
def place(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def tables(spark, *numbers):
    return [publish.ServingTable(n, spark.range(k).withColumn("v", F.lit(k))) for n, k in zip("abc", numbers)]


def sizes(spark, root):
    snapshot = publish.open_snapshot(spark, root)
    return {n: snapshot.read(spark, n).count() for n in snapshot.tables}


def test_a_failure_between_two_tables_changes_nothing(spark, place):
    assert publish.open_snapshot(spark, place) is None
    publish.publish_snapshot(spark, place, tables(spark, 3, 4))
    broken = [publish.ServingTable("a", spark.range(9)), publish.ServingTable("b", spark.range(9).withColumn("v", F.raise_error(F.lit("no"))))]
    with pytest.raises(Exception, match="no"):
        publish.publish_snapshot(spark, place, broken)
    assert sizes(spark, place) == {"a": 3, "b": 4}
    with pytest.raises(ValueError, match="realized"):
        publish.publish_snapshot(spark, place, [publish.ServingTable("a", spark.range(9)), publish.ServingTable("b", spark.range(1).withColumn("Delivery_Status", F.lit(1)))])
    assert publish.open_snapshot(spark, place).number == 1 and sizes(spark, place) == {"a": 3, "b": 4}


def test_versions_parts_and_conflicts(spark, place):
    first = publish.publish_snapshot(spark, place, tables(spark, 3, 4))
    # A table may read its own old version, and tables that are not given stay.
    own = first.read(spark, "a")
    second = publish.publish_snapshot(spark, place, [publish.ServingTable("a", own.unionByName(own))])
    assert sizes(spark, place) == {"a": 6, "b": 4} and second.tables["a"]["row_count"] == 6
    assert publish.open_snapshot(spark, place, 1).read(spark, "a").count() == 3
    with pytest.raises(publish.PublishConflict):
        publish.publish_snapshot(spark, place, tables(spark, 1), base=first)
    assert sizes(spark, place) == {"a": 6, "b": 4}
    # A record whose writer broke off is no commit, and does not stop the next one.
    fs, path = files.file_system(spark, f"{place}/{publish.COMMITS}/{3:012d}.json")
    stream = fs.create(path, False)
    stream.write(b'{"number": 3, "tab')
    stream.close()
    assert publish.open_snapshot(spark, place).number == 2
    publish.publish_snapshot(spark, place, tables(spark, 5))
    assert publish.open_snapshot(spark, place).number == 4 and sizes(spark, place) == {"a": 5, "b": 4}
    gone = publish.expire_snapshots(spark, place, keep=1)
    assert len(gone) == 2 and sizes(spark, place) == {"a": 5, "b": 4} and publish.open_snapshot(spark, place, 1) is None


def test_catalog_names_follow_the_commit(spark, place):
    schema = f"s{uuid.uuid4().hex[:8]}"
    publish.publish_tables(spark, schema, tables(spark, 2, 3), place)
    manifest = publish.publish_tables(spark, schema, tables(spark, 7, 8), place)
    assert spark.table(f"{schema}.a").count() == 7 and spark.table(f"{schema}.b").count() == 8
    assert sorted((r["target_table"], r["row_count"], r["column_count"]) for r in manifest.collect()) == [(f"{schema}.a", 7, 2), (f"{schema}.b", 8, 2)]
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_a_table_is_replaced_whole_or_not_at_all(spark, place):
    path = f"{place}/t"
    files.write_table(spark.range(5), path)
    files.write_table(files.read_table(spark, path).withColumn("twice", F.col("id") * 2), path)  # reads what it replaces
    assert files.read_table(spark, path).agg(F.sum("twice")).first()[0] == 20
    with pytest.raises(Exception, match="no"):
        files.write_table(spark.range(9).withColumn("v", F.raise_error(F.lit("no"))), path)
    assert files.read_table(spark, path).columns == ["id", "twice"]
    fs, folder = files.file_system(spark, place)
    assert [s.getPath().getName() for s in fs.listStatus(folder)] == ["t"]
    assert files.write_table(spark.range(2).withColumn("twice", F.lit(0).cast("long")), path, mode="append").count() == 7


def test_silver_is_measured_while_it_is_written(spark):
    spec = cleaning.SilverSpec(integers=["n"], doubles=["x"], timestamps=["t"], text=["s"], watched_gaps=["s", "t"])
    rows = [("1", "2.5", "1/2/2020 3:04", " a  b "), ("x", None, "?", " "), ("3.7", "y", None, None), ("", "1", "1/2/2020 3:04", "c")] * 5
    bronze = spark.createDataFrame(rows, "n STRING, x STRING, t STRING, s STRING").repartition(3)
    for keep, written in ((None, 20), (F.col("n") == 1, 5), (F.lit(False), 0)):
        silver, report = cleaning.write_silver(bronze, lambda df: materialize(df, "silver"), spec, keep, expected_rows=20)
        again = cleaning.quality_report(bronze, silver, spec, expected_rows=20)
        values = lambda df: [(r["metric_name"], r["metric_value"], r["metric_details"]) for r in df.collect()]
        assert values(report) == values(again) and silver.count() == written
        found = {r["metric_name"]: r["metric_value"] for r in report.collect()}
        assert found["silver_row_count"] == str(written) and found["invalid_integer_cast_n"] == "5" and found["missing_s"] == "10"
        assert found["invalid_decimal_cast_x"] == "5" and found["invalid_timestamp_parse_t"] == "5"
