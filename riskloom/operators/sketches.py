"""Distinct counts from mergeable sketches, with stated bounds, next to the exact ones.

An exact distinct count shuffles every value.  Here each task keeps one HyperLogLog sketch of
``2^precision`` registers for each column and group, only sketches are shuffled, and stored
sketches of days merge to those of weeks or months without reading the rows again.

The relative standard error of a merged sketch is 1.04 / sqrt(2^precision): 1.6% by default.  The
bounds that come with an estimate are three standard errors wide on either side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 12
COLUMN, SKETCH = "column_name", "distinct_sketch"


def relative_error(precision: int = PRECISION) -> float:
    """Standard error of an estimate, as a share of the true count."""
    if not 4 <= precision <= 21:
        raise ValueError("precision goes from 4 to 21")
    return 1.04 / math.sqrt(1 << precision)


def distinct_sketch(value: Column, precision: int = PRECISION) -> Column:
    """Aggregate: the sketch of all values that are not null, of any type; empty text is a value."""
    relative_error(precision)
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), precision)


def distinct_estimate(value: Column, precision: int = PRECISION) -> Column:
    """Aggregate: the estimated number of distinct values that are not null."""
    return F.hll_sketch_estimate(distinct_sketch(value, precision))


def bounds(estimate: Column, precision: int = PRECISION) -> tuple[Column, Column]:
    """Least and greatest true count that lie within three standard errors of the estimate."""
    reach = 3 * relative_error(precision)
    upper = F.ceil(estimate / (1 - reach)) if reach < 1 else F.lit(None)
    return F.floor(estimate / (1 + reach)).cast("long"), upper.cast("long")


def distinct_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), precision: int = PRECISION
) -> DataFrame:
    """``by``, ``column_name``, ``row_count``, ``filled_count``, ``distinct_sketch``: one aggregation over the rows.

    Null groups are groups.  An empty table gives no rows with ``by``, and empty sketches without.
    """
    clash = {COLUMN, SKETCH, "row_count", "filled_count"} & set(by)
    if clash or not columns:
        raise ValueError(f"groups named like the result: {sorted(clash)}" if clash else "no columns")
    made = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(F.col(c)).alias(f"_filled_{i}") for i, c in enumerate(columns)],
        *[distinct_sketch(F.col(c), precision).alias(f"_sketch_{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias(COLUMN), F.col("row_count"), F.col(f"_filled_{i}").alias("filled_count"),
                     F.col(f"_sketch_{i}").alias(SKETCH)) for i, c in enumerate(columns)]
    return made.select(*by, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the same precision, merged to one for each column and group of ``by``."""
    return sketches.groupBy(*by, COLUMN).agg(
        F.sum("row_count").alias("row_count"), F.sum("filled_count").alias("filled_count"),
        F.hll_union_agg(SKETCH).alias(SKETCH))


def estimates(sketches: DataFrame, precision: int = PRECISION) -> DataFrame:
    """The sketches' ``distinct_values`` with ``distinct_lower`` and ``distinct_upper``; never more than the filled rows."""
    found = F.least(F.hll_sketch_estimate(SKETCH), F.col("filled_count"))
    low, high = bounds(F.col("distinct_values"), precision)
    return sketches.withColumn("distinct_values", found).withColumns(
        {"distinct_lower": low, "distinct_upper": F.least(high, F.col("filled_count"))}).drop(SKETCH)


def estimated_cardinality(df: DataFrame, columns: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """As ``contracts.cardinality``, from sketches, with bounds."""
    return estimates(distinct_sketches(df, columns, precision=precision), precision).select(
        COLUMN, "distinct_values", "distinct_lower", "distinct_upper")


# --- stored by day -------------------------------------------------------------
def store_daily_sketches(
    df: DataFrame, day: Column, columns: Sequence[str], path: str, by: Sequence[str] = (), precision: int = PRECISION
) -> None:
    """Put the sketches of the days of ``df`` into the table at ``path``, partitioned by ``sketch_day``.

    A day that comes again replaces that day alone, so a load may be repeated; each load has to bring
    whole days.  Rows without a day are kept under a null day.
    """
    dated = df.select(*by, *[c for c in columns if c not in by], day.cast("date").alias("sketch_day"))
    made = distinct_sketches(dated, columns, ["sketch_day", *by], precision)
    made.repartition("sketch_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "sketch_day").parquet(path)


def read_daily_sketches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches of the days from ``first`` to ``last`` (both included); other days are not read."""
    rows = spark.read.parquet(path)
    for bound, keep in ((first, lambda d: F.col("sketch_day") >= d), (last, lambda d: F.col("sketch_day") <= d)):
        rows = rows if bound is None else rows.where(keep(F.lit(bound).cast("date")))
    return rows


def rolling_distinct(daily: DataFrame, days: int, by: Sequence[str] = (), precision: int = PRECISION) -> DataFrame:
    """Estimates over the last ``days`` days, for every day that has a sketch.

    Distinct counts of days do not add up; their sketches merge.  A sketch goes to ``days`` rows at most.
    """
    if days < 1:
        raise ValueError("at least one day")
    held = daily.where("sketch_day is not null")
    ends = held.select("sketch_day").distinct()
    spread = held.withColumn("sketch_day", F.explode(F.sequence("sketch_day", F.date_add("sketch_day", days - 1))))
    return estimates(merge_sketches(spread.join(ends, "sketch_day", "left_semi"), ["sketch_day", *by]), precision)
