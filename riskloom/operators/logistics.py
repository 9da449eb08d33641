"""Logistics KPIs: month-grain summary and order-item detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import mean, ratio, total
from ..functions.bands import risk_band, risk_band_order
from ..functions.calendar import delivery_columns, month_key
from ..functions.text import label_or
from .decisions import action_queue_columns, confusion_columns

# FIXED VALUES: label source and its fallback.
_LABELS = {
    "market_normalized": ("market_normalized", "unknown_market"),
    "map_location_country": ("order_country_normalized", "unknown_country"),
    "map_location_region": ("order_region_normalized", "unknown_region"),
    "map_location_state": ("order_state_normalized", "unknown_state"),
    "shipping_mode_normalized": ("shipping_mode_normalized", "unknown_shipping_mode"),
    "shipping_speed_tier": ("shipping_speed_tier", "unknown_speed_tier"),
    "product_category_key": ("product_category_key", "unknown_category"),
    "product_department_key": ("product_department_key", "unknown_department"),
}
SUMMARY_GRAIN = [
    "order_month_key", "order_year", "order_month", *_LABELS, N.SEGMENT,
    "ao3_action_queue_label", "ao3_action_queue_sort_order", "risk_band", "risk_band_sort_order",
]


def _keys() -> dict[str, Column]:
    """The least columns that make up the grain; ``_derived`` gives the others."""
    return {
        "_month": F.trunc(F.col(N.ORDER_TS), "month"),
        **{name: label_or(source, rest) for name, (source, rest) in _LABELS.items()},
        N.SEGMENT: F.col(N.SEGMENT),
        "risk_band": risk_band(),
    }


def _derived(ts: Column, band: Column) -> dict[str, Column]:
    return {
        "order_month_key": month_key(ts), "order_year": F.year(ts), "order_month": F.month(ts),
        **action_queue_columns(), "risk_band_sort_order": risk_band_order(band),
    }


def logistics_kpi_summary(df: DataFrame) -> DataFrame:
    """Delivery history, predicted exposure and queue load per month and dimension set.

    ``df`` carries segments, shipping/product and regional features and the actual
    and scheduled days on one row.
    """
    wide = df.select(
        *[e.alias(n) for n, e in (_keys() | delivery_columns()).items()],
        action_queue_columns()["intervention_required_flag"].alias("intervention_required_flag"),
        N.ORDER, N.RISK, N.HIGH_RISK, N.EXPECTED_PROFIT, N.MARGIN, N.ORDER_VALUE,
        "order_item_quantity", "item_net_sales_amount", "Days_for_shipment_scheduled", "Days_for_shipping_real",
    )
    p, seg = F.col(N.RISK), F.col(N.SEGMENT)
    # The sum of 1 - p over scored rows, written so that it stays exact.
    on_time = F.count(p) - total(N.RISK)
    grouped = wide.groupBy(*_keys()).agg(
        F.countDistinct(N.ORDER).alias("order_count"),
        F.count(F.lit(1)).alias("order_item_count"),
        total("order_item_quantity").alias("units_ordered"),
        total("item_net_sales_amount").alias("total_sales_amount"),
        total(N.ORDER_VALUE).alias("total_order_value"),
        F.sum("valid_delivery_metric_flag").alias("valid_delivery_metric_count"),
        F.sum("actual_on_time_delivery_flag").alias("historical_on_time_count"),
        F.sum("actual_late_delivery_flag").alias("historical_late_count"),
        mean("Days_for_shipment_scheduled").alias("avg_scheduled_shipping_days"),
        mean("Days_for_shipping_real").alias("avg_actual_shipping_days"),
        mean("delivery_delay_gap").alias("avg_delivery_delay_gap"),
        mean(N.RISK).alias("expected_late_delivery_rate"),
        ratio(on_time, F.count(p)).alias("expected_otd_rate"),
        total(N.RISK).alias("expected_late_order_equivalent_count"),
        on_time.alias("expected_on_time_order_equivalent_count"),
        F.count_if(F.col(N.HIGH_RISK)).alias("high_risk_order_count"),
        F.count_if(seg == N.PROTECT).alias("service_protection_queue_count"),
        F.count_if(seg == N.EXPEDITE).alias("selective_expedite_review_count"),
        F.count_if(seg == N.PRESERVE).alias("preserve_service_queue_count"),
        F.count_if(seg == N.STANDARD).alias("standard_process_queue_count"),
        F.sum("intervention_required_flag").alias("intervention_required_count"),
        mean(N.EXPECTED_PROFIT).alias("avg_predicted_order_profit"),
        mean(N.MARGIN).alias("avg_predicted_margin"),
        total(N.EXPECTED_PROFIT).alias("total_predicted_profit"),
    )
    c = F.col
    measures = [name for name in grouped.columns if name not in _keys()]
    derived = _derived(F.col("_month"), F.col("risk_band"))
    grouped = grouped.withColumns({n: e for n, e in derived.items() if n in SUMMARY_GRAIN}).select(*SUMMARY_GRAIN, *measures)
    rated = grouped.withColumns(
        {
            "historical_otd_rate": ratio(c("historical_on_time_count"), c("valid_delivery_metric_count")),
            "historical_late_delivery_rate": ratio(c("historical_late_count"), c("valid_delivery_metric_count")),
            "high_risk_delivery_exposure_rate": ratio(c("high_risk_order_count"), c("order_item_count")),
            "intervention_load_rate": ratio(c("intervention_required_count"), c("order_item_count")),
        }
    )
    return rated.withColumn("expected_otd_exposure_pp", c("historical_otd_rate") - c("expected_otd_rate"))


def order_kpi_detail(df: DataFrame) -> DataFrame:
    """Order-item detail with outcome, prediction and queue flags; same input as the summary."""
    outcome = delivery_columns()
    keys = _keys()
    queue = keys | _derived(F.col(N.ORDER_TS), keys["risk_band"])
    del queue["_month"]
    flagged = F.coalesce(F.col(N.HIGH_RISK).cast("int"), F.lit(0))
    p = F.col(N.RISK).cast("double")
    late, on_time = (outcome[f"actual_{k}_delivery_flag"] for k in ("late", "on_time"))
    columns = {
        **{k: F.col(k) for k in (*N.KEYS, N.SHIP_TS)},
        **queue,
        **{k: F.col(k).cast("double") for k in ("order_item_quantity", "item_net_sales_amount", N.ORDER_VALUE)},
        "Days_for_shipment_scheduled": F.col("Days_for_shipment_scheduled"),
        "Days_for_shipping_real": F.col("Days_for_shipping_real"),
        "scheduled_shipping_days": F.col("Days_for_shipment_scheduled").cast("double"),
        "actual_shipping_lead_time": F.col("Days_for_shipping_real").cast("double"),
        **outcome,
        "delivery_status_normalized": label_or("Delivery_Status", "unknown_delivery_status"),
        N.RISK: p,
        "ao1_expected_on_time_probability": 1.0 - p,
        N.HIGH_RISK: flagged,
        **confusion_columns(flagged, late, on_time),
        **{k: F.col(k).cast("double") for k in (N.EXPECTED_PROFIT, N.MARGIN)},
    }
    return df.select(*[e.alias(n) for n, e in columns.items()])
