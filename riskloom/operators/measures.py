"""Business measures over the segment table.

A measure is a function from a row condition to an aggregate expression.  The
condition plays the role of a filter context: the same definition serves totals,
groups and the time windows of a period comparison, in one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import digits_of, mean, ratio, total
from ..functions.bands import profit_band
from ..functions.calendar import week_start
from ..session import materialize
from .sketches import distinct_estimate

Measure = Callable[[Column], Column]


def _segment(name: str) -> Column:
    return F.col(N.SEGMENT) == name


def _risky() -> Column:
    return F.col(N.HIGH_RISK)


def _losing() -> Column:
    return F.col(N.EXPECTED_PROFIT) < 0


def _count(extra: Callable[[], Column] | None = None) -> Measure:
    return lambda w: F.count_if(w & extra() if extra else w)


def _sum(column: str, extra: Callable[[], Column] | None = None) -> Measure:
    return lambda w: total(F.when(w & extra() if extra else w, F.col(column)), digits_of(column))


def _mean(column: str, extra: Callable[[], Column] | None = None) -> Measure:
    return lambda w: mean(F.when(w & extra() if extra else w, F.col(column)), digits_of(column))


def _over(top: str, bottom: str) -> Measure:
    return lambda w: ratio(MEASURES[top](w), MEASURES[bottom](w))


def _minus(a: str, b: str) -> Measure:
    return lambda w: MEASURES[a](w) - MEASURES[b](w)


MEASURES: dict[str, Measure] = {
    # core
    "total_items": _count(),
    "high_risk_items": _count(_risky),
    "high_risk_rate": _over("high_risk_items", "total_items"),
    "low_risk_items": _minus("total_items", "high_risk_items"),
    "low_risk_rate": _over("low_risk_items", "total_items"),
    "expected_profit": _sum(N.EXPECTED_PROFIT),
    "average_expected_profit": _mean(N.EXPECTED_PROFIT),
    "total_order_value": _sum(N.ORDER_VALUE),
    "expected_profit_margin": _over("expected_profit", "total_order_value"),
    "average_late_risk": _mean(N.RISK),
    "average_predicted_margin": _mean(N.MARGIN),
    "risk_cutoff": lambda w: F.max(F.when(w, F.col("ao3_risk_cutoff"))),
    "margin_cutoff": lambda w: F.max(F.when(w, F.col("ao3_margin_cutoff"))),
    # profit sign
    "negative_profit_items": _count(_losing),
    "negative_profit_rate": _over("negative_profit_items", "total_items"),
    "positive_profit_items": _minus("total_items", "negative_profit_items"),
    "positive_profit_rate": _over("positive_profit_items", "total_items"),
    "negative_profit_exposure": lambda w: F.abs(total(F.when(w & _losing(), F.col(N.EXPECTED_PROFIT)))),
    # segments
    "protect_items": _count(lambda: _segment(N.PROTECT)),
    "expedite_items": _count(lambda: _segment(N.EXPEDITE)),
    "preserve_items": _count(lambda: _segment(N.PRESERVE)),
    "standard_items": _count(lambda: _segment(N.STANDARD)),
    "protect_share": _over("protect_items", "total_items"),
    "expedite_share": _over("expedite_items", "total_items"),
    "preserve_share": _over("preserve_items", "total_items"),
    "standard_share": _over("standard_items", "total_items"),
    "protected_value": _sum(N.ORDER_VALUE, lambda: _segment(N.PROTECT)),
    "protected_profit": _sum(N.EXPECTED_PROFIT, lambda: _segment(N.PROTECT)),
    "protected_value_share": _over("protected_value", "total_order_value"),
    "protected_profit_share": _over("protected_profit", "expected_profit"),
    "expedite_value": _sum(N.ORDER_VALUE, lambda: _segment(N.EXPEDITE)),
    "expedite_profit": _sum(N.EXPECTED_PROFIT, lambda: _segment(N.EXPEDITE)),
    "expedite_value_share": _over("expedite_value", "total_order_value"),
    "average_protect_value": _over("protected_value", "protect_items"),
    "priority_review_items": lambda w: MEASURES["protect_items"](w) + MEASURES["expedite_items"](w),
    "priority_review_rate": _over("priority_review_items", "total_items"),
    # high risk
    "high_risk_value": _sum(N.ORDER_VALUE, _risky),
    "high_risk_value_share": _over("high_risk_value", "total_order_value"),
    "high_risk_negative_profit_items": _count(lambda: _risky() & _losing()),
}

CORE = list(MEASURES)[:13]
PROFIT_SIGN = list(MEASURES)[13:18]
SEGMENT_KPIS = list(MEASURES)[18:36]
HIGH_RISK_KPIS = list(MEASURES)[36:]
WEEKLY = ["total_items", "high_risk_items", "high_risk_rate", "expected_profit", "expected_profit_margin",
          "protect_items", "protected_value", "expedite_items"]


def measure_set(df: DataFrame, measures: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """The named measures, overall or per group, in one aggregation."""
    everything = F.lit(True)
    return df.groupBy(*by).agg(*[MEASURES[m](everything).alias(m) for m in measures])


def dashboard_qa(df: DataFrame) -> DataFrame:
    """Rows with missing or impossible values, their total and the pass flag."""
    risk = F.col(N.RISK)
    issues = {
        "rows_missing_segment": F.col(N.SEGMENT).isNull(),
        "rows_missing_risk_score": risk.isNull(),
        "rows_missing_expected_profit": F.col(N.EXPECTED_PROFIT).isNull(),
        "rows_missing_predicted_margin": F.col(N.MARGIN).isNull(),
        "rows_invalid_probability": (risk < 0) | (risk > 1),
        "rows_nonpositive_value": F.col(N.ORDER_VALUE) <= 0,
    }
    out = df.agg(*[F.count_if(bad).alias(n) for n, bad in issues.items()])
    whole = sum((F.col(n) for n in list(issues)[1:]), F.col(list(issues)[0]))
    return out.withColumn("issue_rows", whole).withColumn("pass_flag", (F.col("issue_rows") == 0).cast("int"))


def validation_kpis(metrics: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """The listed metrics of one model's row."""
    return metrics.where(F.col("model_name") == model).agg(*[F.max(c).alias(c) for c in columns])


def geographic_kpis(summary: DataFrame, by: Sequence[str] = (), precision: int | None = None) -> DataFrame:
    """Location counts, item sums and rates over the geographic summary.

    With ``precision``, distinct counts are estimates from sketches of that precision.
    """
    distinct = F.countDistinct if precision is None else lambda c: distinct_estimate(F.col(c), precision)
    items, risky = F.sum("order_item_count"), F.sum("high_risk_order_count")
    profit, value = total("total_predicted_profit"), total("total_order_value")
    return summary.groupBy(*by).agg(
        F.count(F.lit(1)).alias("geo_locations"),
        distinct("map_location_country").alias("geo_countries"),
        distinct("map_location_region").alias("geo_regions"),
        distinct("map_location_state").alias("geo_states"),
        items.alias("geo_order_items"), risky.alias("geo_high_risk_items"),
        ratio(risky, items).alias("geo_high_risk_rate"),
        F.sum(f"{N.PROTECT}_count").alias("geo_protect_items"),
        F.sum(f"{N.EXPEDITE}_count").alias("geo_expedite_items"),
        value.alias("geo_order_value"), profit.alias("geo_expected_profit"),
        ratio(profit, value).alias("geo_expected_margin"),
        ratio(F.count_if(F.col("geo_coordinates_available") == 1), F.count(F.lit(1))).alias("geo_coordinate_coverage"),
    )


# --- time ------------------------------------------------------------------
def weekly_measures(df: DataFrame, measures: Sequence[str] = WEEKLY) -> DataFrame:
    """Measures per Monday-start week."""
    return measure_set(df, measures, [week_start().alias("order_week_start")])


def run_rate_4w(df: DataFrame) -> DataFrame:
    """Weekly protected value and its mean over the weeks present in the last four.

    The window runs over weekly totals, so its single partition holds one row per
    calendar week, whatever the size of the table.
    """
    weekly = measure_set(df, ["protected_value"], [week_start().alias("order_week_start")])
    return with_run_rate(weekly)


def with_run_rate(weekly: DataFrame) -> DataFrame:
    """Adds the run rate to weekly totals (one row per week)."""
    week_number = F.datediff("order_week_start", F.lit("1970-01-05").cast("date"))
    last_four = Window.orderBy(week_number).rangeBetween(-21, 0)
    v = F.col("protected_value")
    return weekly.withColumn("run_rate_4w", ratio(F.sum(v.cast("decimal(38,6)")).over(last_four), F.count(v).over(last_four)))


def weekly_trend(df: DataFrame, weeks: int = 12) -> DataFrame:
    """The latest weeks with measures, run rate and chronological rank."""
    weekly = with_run_rate(weekly_measures(df))
    latest = weekly.where("protect_items > 0").orderBy(F.desc("order_week_start")).limit(weeks)
    return dense_rank_weeks(latest)


def dense_rank_weeks(weekly: DataFrame) -> DataFrame:
    """Rank weeks oldest first; the input has one row per week."""
    return weekly.withColumn("week_rank", F.dense_rank().over(Window.orderBy("order_week_start")))


def period_over_period(
    df: DataFrame, measures: Sequence[str], days: int = 28, deltas: Sequence[str] = ()
) -> DataFrame:
    """Each measure over the last ``days`` and the ``days`` before, with the change.

    Windows are anchored at the latest timestamp and open on the left.  Measures in
    ``deltas`` report a difference, the others a relative change.
    """
    ts = F.col(N.ORDER_TS)
    last = df.agg(F.max(N.ORDER_TS)).scalar()
    back = F.make_dt_interval(F.lit(days))
    middle, start = last - back, last - back - back
    recent = df.where(ts > start)
    windows = {"current": ts > middle, "prior": ts <= middle}
    out = recent.agg(*[MEASURES[m](w).alias(f"{k}_{m}") for m in measures for k, w in windows.items()])
    changes = {}
    for m in measures:
        now, then = (F.coalesce(F.col(f"{k}_{m}"), F.lit(0)) for k in windows)
        changes[f"{m}_delta" if m in deltas else f"{m}_change"] = (
            now - then if m in deltas else ratio(now - then, then)
        )
    return out.withColumns(changes)


# --- queues, rankings ------------------------------------------------------
QUEUE_COLUMNS = [*N.KEYS, N.RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN, N.SEGMENT]


def review_queue(df: DataFrame) -> DataFrame:
    """High risk and expected loss: the items to look at first, most valuable first."""
    return df.where(_risky() & _losing()).select(*QUEUE_COLUMNS).orderBy(
        F.desc(N.ORDER_VALUE), F.desc(N.RISK), *N.CHRONOLOGY)


def loss_queue(df: DataFrame) -> DataFrame:
    return df.where(_losing()).select(*QUEUE_COLUMNS).orderBy(N.EXPECTED_PROFIT, *N.CHRONOLOGY)


def _top_k(df: DataFrame, keep: Column, column: str, k: int, largest: bool) -> DataFrame:
    """Sum over the ``k`` most extreme rows, ties at the edge included, and over all kept rows."""
    # Read for the edge and for the sums, so what lies below is done once.
    kept = materialize(df.where(keep).select(F.col(column).alias("v")).where("v IS NOT NULL"), "values")
    edge = kept.orderBy(F.desc("v") if largest else F.asc("v")).limit(k)
    edge = edge.agg(F.min("v") if largest else F.max("v")).scalar()
    inside = F.col("v") >= edge if largest else F.col("v") <= edge
    return kept.agg(
        F.abs(total(F.when(inside, F.col("v")))).alias("top_total"), F.abs(total("v")).alias("whole_total"))


def top_loss_exposure(df: DataFrame, k: int = 10) -> DataFrame:
    """Loss carried by the ``k`` worst items and its share of all losses."""
    out = _top_k(df, _losing(), N.EXPECTED_PROFIT, k, largest=False)
    return out.select(F.col("top_total").alias("top_loss_exposure"), F.col("whole_total").alias("negative_profit_exposure"),
                      ratio(F.col("top_total"), F.col("whole_total")).alias("top_loss_concentration"))


def top_expedite_value(df: DataFrame, k: int = 10) -> DataFrame:
    out = _top_k(df, _segment(N.EXPEDITE), N.ORDER_VALUE, k, largest=True)
    return out.select(F.col("top_total").alias("top_expedite_value"), F.col("whole_total").alias("expedite_value"),
                      ratio(F.col("top_total"), F.col("whole_total")).alias("top_expedite_value_share"))


def hotspots(summary: DataFrame, by: str = "volume", k: int = 10, min_items: int = 100) -> DataFrame:
    """Top countries by high-risk items, or by high-risk rate among those with enough items."""
    items, risky = F.sum("order_item_count"), F.sum("high_risk_order_count")
    per = summary.groupBy("map_location_country").agg(
        risky.alias("risk_items"), items.alias("order_items"), ratio(risky, items).alias("risk_rate"))
    if by == "rate":
        per = per.where(F.col("order_items") >= min_items)
    key = "risk_rate" if by == "rate" else "risk_items"
    # Names are free text, so only those that reach the k-th value are ranked; ties at the edge stay in.
    per = materialize(per, "places")
    edge = per.where(F.col(key).isNotNull()).orderBy(F.desc(key)).limit(k).agg(F.min(key)).scalar()
    return per.where(F.col(key) >= edge).withColumn("hotspot_rank", F.rank().over(Window.orderBy(F.desc(key))))


def top_n(df: DataFrame, category: str, n: int = 20) -> DataFrame:
    """Most frequent values of a column; NULL counts as a value."""
    return df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("NULL")).alias("category")).agg(
        F.count(F.lit(1)).alias("row_count")
    ).orderBy(F.desc("row_count"), "category").limit(n)


# --- distributions ---------------------------------------------------------
def profit_band_dim(df: DataFrame) -> DataFrame:
    rows = [(b, i) for i, b in enumerate(N.PROFIT_BANDS_TO, 1)]
    return df.sparkSession.createDataFrame(rows, "profit_band STRING, profit_band_sort INT")


def profit_band_distribution(df: DataFrame) -> DataFrame:
    """Items per expected-profit band, empty bands included."""
    counted = df.groupBy(profit_band(labels=N.PROFIT_BANDS_TO).alias("profit_band")).agg(
        F.count(F.lit(1)).alias("n"))
    joined = counted.join(profit_band_dim(df), "profit_band", "right")
    n = F.coalesce("n", F.lit(0))
    whole = F.sum(n).over(Window.partitionBy(F.lit(1)))  # six rows
    return joined.select("profit_band", "profit_band_sort", n.alias("item_count"), ratio(n, whole).alias("item_share"))


def economic_quadrants(df: DataFrame) -> DataFrame:
    """Items, value, profit and mean margin of each operational segment, as one row per segment."""
    kept = df.where(F.col(N.SEGMENT).isin(*N.OPERATIONAL_SEGMENTS))
    return measure_set(
        kept, ["total_items", "total_order_value", "expected_profit", "average_predicted_margin"], [N.SEGMENT])


def portfolio_mix(df: DataFrame) -> DataFrame:
    """Segment shares of the whole portfolio in one row."""
    return measure_set(df, ["protect_share", "expedite_share", "preserve_share", "standard_share"])
