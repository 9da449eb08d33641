"""Calendar expressions.

Inputs may be TIMESTAMP, TIMESTAMP_NTZ or DATE.  Weekday numbers follow Spark's
``dayofweek`` (1 = Sunday) unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from .text import _c


def season(month: Column | str) -> Column:
    """Meteorological season; an unknown month falls to ``fall`` like any other rest."""
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.between(3, 5), "spring")
        .when(m.between(6, 8), "summer")
        .otherwise("fall")
    )


def order_time_columns(ts: Column | str = N.ORDER_TS) -> dict[str, Column]:
    """The order-time features by name, ready for one ``withColumns``."""
    t = _c(ts)
    return {
        "order_year": F.year(t),
        "order_quarter": F.quarter(t),
        "order_month": F.month(t),
        "order_week_of_year": F.weekofyear(t),
        "order_day_of_month": F.dayofmonth(t),
        "order_day_of_week": F.dayofweek(t),
        "order_hour": F.hour(t.cast("timestamp_ntz")),
        "order_is_weekend": F.coalesce(F.dayofweek(t).isin(1, 7).cast("int"), F.lit(0)),
        "order_season": season(F.month(t)),
    }


def order_time_features(df: DataFrame, ts: Column | str = N.ORDER_TS) -> DataFrame:
    """All input columns plus the order-time features."""
    return df.withColumns(order_time_columns(ts))


def day_key(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd").cast("int")


def week_key(ts: Column | str) -> Column:
    """ISO week key such as ``2016-W52``.

    Week-based date patterns are rejected by the current formatter, so the key is
    assembled from the ISO week-numbering year and the ISO week.
    """
    t = _c(ts)
    year = F.extract(F.lit("YEAROFWEEK"), t).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def month_key(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def period_columns(ts: Column | str = N.ORDER_TS) -> dict[str, Column]:
    return {
        "order_date_key": day_key(ts),
        "order_week_key": week_key(ts),
        "order_month_key": month_key(ts),
    }


def week_start(ts: Column | str = N.ORDER_TS) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", _c(ts)).cast("date")


def calendar_dim(spark: SparkSession, start: str = "2015-01-01", end: str = "2018-12-31") -> DataFrame:
    """One row per day of the closed date range, with the reporting attributes."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
        ).alias("date")
    )
    return add_calendar_attributes(days)


def calendar_for(df: DataFrame, ts: Column | str = N.ORDER_TS) -> DataFrame:
    """Calendar spanning exactly the days between the first and last timestamp of ``df``."""
    span = df.agg(F.min(_c(ts)).cast("date").alias("a"), F.max(_c(ts)).cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return add_calendar_attributes(days)


def add_calendar_attributes(days: DataFrame) -> DataFrame:
    d = F.col("date")
    iso_day = F.weekday(d) + 1
    new_year = F.trunc(d, "year")
    # Weeks start on Monday and week 1 is the one holding 1 January.
    week_number = F.floor((F.dayofyear(d) - 1 + F.weekday(new_year)) / 7).cast("int") + 1
    return days.select(
        d,
        F.year(d).alias("year"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMM").alias("month"),
        month_key(d).alias("year_month"),
        week_start(d).alias("week_start"),
        week_number.alias("week_number"),
        F.dayofmonth(d).alias("day"),
        iso_day.alias("day_of_week_number"),
        F.date_format(d, "EEE").alias("day_of_week"),
    )


def delivery_columns(
    actual: Column | str = "Days_for_shipping_real",
    scheduled: Column | str = "Days_for_shipment_scheduled",
) -> dict[str, Column]:
    """Delay gap in days and the on-time / late / measurable flags."""
    gap = _c(actual).cast("double") - _c(scheduled).cast("double")
    return {
        "delivery_delay_gap": gap,
        "valid_delivery_metric_flag": gap.isNotNull().cast("int"),
        "actual_on_time_delivery_flag": F.coalesce((gap <= 0).cast("int"), F.lit(0)),
        "actual_late_delivery_flag": F.coalesce((gap > 0).cast("int"), F.lit(0)),
    }
