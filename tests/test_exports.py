"""Exports that share a source."""

from pyspark.sql import functions as F

from riskloom.sources import publish


def test_shared_source_of_exports_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    source = spark.range(30).select(F.udf(counted, "long")("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("x").alias("c"))
    out = publish.export_tables([publish.ServingTable("all", source, ["a", "b"]), publish.ServingTable("some", source, ["a"])], str(tmp_path / "e"))
    rows = {r["export_name"]: (r["row_count"], r["column_count"], r["run_status"]) for r in out.collect()}
    assert rows == {"all": (30, 2, "success"), "some": (30, 1, "success")}
    assert seen.value == 30
    assert spark.read.option("header", True).csv(str(tmp_path / "e/some")).count() == 30
