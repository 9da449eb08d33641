"""Serving summaries."""

from pyspark.sql import functions as F

from .. import names as N
from ..operators import contracts, geography, logistics
from ..operators.features import customer_regional_columns, shipping_product_columns
from ..session import materialize
from . import oracle as O
from .orders import segments
from .registry import query

_COUNTS = """count(DISTINCT Order_Id) AS order_count, count(*) AS order_item_count,
  count(*) FILTER (risky) AS high_risk_order_count, count(*) FILTER (rich) AS high_margin_order_count,
  CAST(sum(p) AS DOUBLE) / count(p) AS avg_ao1_predicted_late_delivery_probability,
  CAST(sum(profit) AS DOUBLE) / count(profit) AS avg_ao2_predicted_order_profit,
  CAST(sum(margin) AS DOUBLE) / CASE WHEN count(margin) > 0 THEN count(margin) END AS avg_ao3_predicted_margin,
  CAST(sum(profit) AS DOUBLE) AS total_predicted_profit, CAST(sum(value) AS DOUBLE) AS total_order_value,
  count(*) FILTER (segment = 'protect_high_value_at_risk') AS protect_high_value_at_risk_count,
  count(*) FILTER (segment = 'expedite_selectively') AS expedite_selectively_count,
  count(*) FILTER (segment = 'preserve_service') AS preserve_service_count,
  count(*) FILTER (segment = 'standard_process') AS standard_process_count,
  count(*) FILTER (segment LIKE 'requires%') AS requires_review_count,
  count(*) FILTER (risky) / count(*) AS high_risk_order_rate, count(*) FILTER (rich) / count(*) AS high_margin_order_rate"""
_COUNTS = _COUNTS.replace("/ count(p) AS", "/ CASE WHEN count(p) > 0 THEN count(p) END AS")
_WHERE = """coalesce(nullif(region_t, ''), 'unknown_region') AS map_location_region, coalesce(nullif(state_t, ''), 'unknown_state') AS map_location_state,
  lat AS map_latitude, lon AS map_longitude,
  CAST(coalesce(has_geo = 1 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, FALSE) AS INT) AS geo_coordinates_available"""


def _placed(spark, sf):
    """Segments with regional features on the same row: no join back is needed."""
    rows = segments(spark, sf, "customer", "place")
    return rows.withColumns(customer_regional_columns())


@query("f1_geographic_summary", O.located(f"""
SELECT concat_ws(', ', map_location_state, map_location_region, map_location_country) AS map_location_label, map_location_country, map_location_region,
  map_location_state, map_latitude, map_longitude, geo_coordinates_available, {_COUNTS},
  min(order_date_DateOrders) AS min_order_date_DateOrders, max(order_date_DateOrders) AS max_order_date_DateOrders
FROM (SELECT *, display_country AS map_location_country, {_WHERE} FROM wide) GROUP BY ALL"""))
def f1(spark, sf):
    return geography.geographic_summary(_placed(spark, sf))


_F2_ROWS = f"""SELECT concat_ws(', ', map_location_state, map_location_region, map_location_country) AS map_location_label, map_location_country, map_location_region,
  map_location_state, map_latitude, map_longitude, geo_coordinates_available, CAST(order_date_DateOrders AS DATE) AS order_date_DateOrders,
  CAST(strftime(order_date_DateOrders, '%Y%m%d') AS INT) AS order_date_key,
  CAST(isoyear(order_date_DateOrders) AS VARCHAR) || '-W' || lpad(CAST(week(order_date_DateOrders) AS VARCHAR), 2, '0') AS order_week_key,
  strftime(order_date_DateOrders, '%Y-%m') AS order_month_key, segment AS ao3_priority_segment, risky AS ao1_high_risk_flag,
  CASE WHEN profit < 0 THEN 'Negative Profit' WHEN profit < 10 THEN '$0 - $10' WHEN profit < 25 THEN '$10 - $25'
      WHEN profit < 50 THEN '$25 - $50' WHEN profit < 100 THEN '$50 - $100' ELSE '$100+' END AS ao2_expected_profit_band, {_COUNTS}
FROM (SELECT *, coalesce(nullif(country_t, ''), 'unknown_country') AS map_location_country, {_WHERE} FROM wide) GROUP BY ALL"""
_FLAG = "* REPLACE (CAST(ao1_high_risk_flag AS VARCHAR) AS ao1_high_risk_flag)"


@query("f2_geographic_segment_summary", O.located(f"SELECT {_FLAG} FROM ({_F2_ROWS})"))
def f2(spark, sf):
    out = geography.geographic_segment_summary(_placed(spark, sf))
    return out.withColumn(N.HIGH_RISK, F.col(N.HIGH_RISK).cast("string"))


@query("k9_i3_i4_i5_geographic_enrichment", O.located(f""",
f2 AS ({_F2_ROWS}),
q AS (SELECT quantile_disc(avg_ao3_predicted_margin, 0.5) FILTER (avg_ao3_predicted_margin >= 0) AS m1,
  quantile_disc(avg_ao3_predicted_margin, 0.75) FILTER (avg_ao3_predicted_margin >= 0) AS m2,
  quantile_disc(total_order_value, 0.25) AS e1, quantile_disc(total_order_value, 0.75) AS e2,
  quantile_disc(high_risk_order_rate, 0.33) AS r1, quantile_disc(high_risk_order_rate, 0.67) AS r2 FROM f2),
t AS (SELECT f2.*, coalesce(ao1_high_risk_flag, FALSE) AS flag,
  CASE WHEN avg_ao3_predicted_margin < 0 THEN 1 WHEN avg_ao3_predicted_margin < m1 THEN 2 WHEN avg_ao3_predicted_margin < m2 THEN 3 ELSE 4 END AS mt,
  CASE WHEN total_order_value >= e2 THEN 1 WHEN total_order_value >= e1 THEN 2 ELSE 3 END AS et,
  CASE WHEN high_risk_order_rate >= r2 THEN 1 WHEN high_risk_order_rate >= r1 THEN 2 ELSE 3 END AS rt,
  CASE WHEN 'unknown_country' = map_location_country OR 'unknown_region' = map_location_region OR 'unknown_state' = map_location_state THEN 'Unknown Geography'
    WHEN geo_coordinates_available = 0 THEN 'Missing Coordinates' ELSE 'Complete Coordinates' END AS quality FROM f2 CROSS JOIN q),
a AS (SELECT *, CASE WHEN quality <> 'Complete Coordinates' THEN 6
  WHEN ao3_priority_segment = 'protect_high_value_at_risk' AND et < 3 AND rt < 3 THEN 1
  WHEN ao3_priority_segment = 'expedite_selectively' THEN 2
  WHEN ao3_priority_segment = 'preserve_service' AND mt > 2 THEN 3
  WHEN ao3_priority_segment = 'standard_process' THEN 4 ELSE 5 END AS arch,
  list_position(['protect_high_value_at_risk', 'expedite_selectively', 'preserve_service', 'standard_process', 'requires_score_review', 'requires_margin_review'], ao3_priority_segment) AS sp FROM t)
SELECT map_location_label, order_date_key, ao3_priority_segment, CAST(ao1_high_risk_flag AS VARCHAR) AS ao1_high_risk_flag, ao2_expected_profit_band, map_latitude,
  ['Protect High-Value at Risk', 'Expedite Selectively', 'Preserve Service', 'Standard Process', 'Requires Score Review', 'Requires Margin Review'][sp] AS ao3_priority_segment_label,
  CASE WHEN sp <= 4 THEN sp ELSE 99 END AS ao3_priority_segment_sort_order,
  CASE WHEN flag THEN 'High Delivery Risk' ELSE 'Standard Delivery Risk' END AS ao1_high_risk_label, CASE WHEN flag THEN 1 ELSE 2 END AS ao1_high_risk_sort_order,
  list_position(['Negative Profit', '$0 - $10', '$10 - $25', '$25 - $50', '$50 - $100', '$100+'], ao2_expected_profit_band) AS ao2_expected_profit_band_sort_order,
  ['Loss or Negative Margin', 'Low Positive Margin', 'Core Positive Margin', 'Strategic Positive Margin'][mt] AS ao2_margin_policy_tier, mt AS ao2_margin_policy_tier_sort_order,
  quality AS geo_data_quality_status,
  ['High Exposure Geography', 'Medium Exposure Geography', 'Low Exposure Geography'][et] AS geo_exposure_tier, et AS geo_exposure_tier_sort_order,
  ['High Risk Intensity', 'Moderate Risk Intensity', 'Low Risk Intensity'][rt] AS geo_risk_intensity_tier, rt AS geo_risk_intensity_tier_sort_order,
  ['Priority Protection Geography', 'Selective Recovery Review', 'Preserve Service Geography', 'Standard Monitoring Geography', 'Operational Monitoring Geography', 'Data Quality Review'][arch] AS geo_decision_archetype,
  [1, 2, 3, 4, 5, 99][arch] AS geo_decision_archetype_sort_order,
  ['Protect Value at Risk', 'Review Selective Expedite', 'Preserve Service Quality', 'Standard Monitoring', 'Monitor Operational Exposure', 'Review Geography Data'][arch] AS geo_recommended_focus
FROM a"""))
def k9(spark, sf):
    # The quantiles and the result both read the summary, so it is stored first.
    summary = materialize(geography.geographic_segment_summary(_placed(spark, sf)), "geo-segments")
    out = geography.enrich_geography(summary)
    new = [c for c in out.columns if c not in summary.columns]
    return out.select("map_location_label", "order_date_key", N.SEGMENT, F.col(N.HIGH_RISK).cast("string").alias(N.HIGH_RISK),
                      "ao2_expected_profit_band", "map_latitude", *new)


def _full(spark, sf):
    rows = segments(spark, sf, "product", "customer", "place", "tokens")
    return rows.withColumns(shipping_product_columns(rows.columns) | customer_regional_columns(rows.columns))


_DIMS = f"""strftime(order_date_DateOrders, '%Y-%m') AS order_month_key, CAST(year(order_date_DateOrders) AS INT) AS order_year, CAST(month(order_date_DateOrders) AS INT) AS order_month,
  coalesce(nullif(region_t, ''), 'unknown_market') AS market_normalized, coalesce(nullif(country_t, ''), 'unknown_country') AS map_location_country,
  coalesce(nullif(region_t, ''), 'unknown_region') AS map_location_region, coalesce(nullif(state_t, ''), 'unknown_state') AS map_location_state,
  {O.token('Shipping_Mode')} AS shipping_mode_normalized, CASE WHEN planned <= 1 THEN 'expedited' WHEN planned <= 3 THEN 'standard' ELSE 'economy' END AS shipping_speed_tier,
  category_key AS product_category_key, department_key AS product_department_key, segment AS ao3_priority_segment,
  CASE segment WHEN 'protect_high_value_at_risk' THEN 'Protect First' WHEN 'expedite_selectively' THEN 'Review Selective Expedite' WHEN 'preserve_service' THEN 'Preserve Service'
    WHEN 'standard_process' THEN 'Standard Process' ELSE 'Review Score or Margin' END AS ao3_action_queue_label,
  CASE segment WHEN 'protect_high_value_at_risk' THEN 1 WHEN 'expedite_selectively' THEN 2 WHEN 'preserve_service' THEN 3 WHEN 'standard_process' THEN 4 ELSE 98 END AS ao3_action_queue_sort_order,
  CASE WHEN p < 0.35 THEN 'Low Risk' WHEN p < 0.65 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_band,
  CASE WHEN p < 0.35 THEN 3 WHEN p < 0.65 THEN 2 ELSE 1 END AS risk_band_sort_order"""


@query("f3_logistics_kpi_summary", O.located(f"""
SELECT *, historical_otd_rate - expected_otd_rate AS expected_otd_exposure_pp FROM (
SELECT {_DIMS}, count(DISTINCT Order_Id) AS order_count, count(*) AS order_item_count, CAST(sum(qty) AS DOUBLE) AS units_ordered,
  CAST(sum(Order_Item_Total) AS DOUBLE) AS total_sales_amount, CAST(sum(value) AS DOUBLE) AS total_order_value,
  count(*) AS valid_delivery_metric_count, count(*) FILTER (actual <= planned) AS historical_on_time_count, count(*) FILTER (actual > planned) AS historical_late_count,
  count(*) FILTER (actual <= planned) / count(*) AS historical_otd_rate, count(*) FILTER (actual > planned) / count(*) AS historical_late_delivery_rate,
  CAST(sum(planned) AS DOUBLE) / count(*) AS avg_scheduled_shipping_days, CAST(sum(actual) AS DOUBLE) / count(*) AS avg_actual_shipping_days,
  CAST(sum(actual - planned) AS DOUBLE) / count(*) AS avg_delivery_delay_gap,
  CAST(sum(p) AS DOUBLE) / CASE WHEN count(p) > 0 THEN count(p) END AS expected_late_delivery_rate,
  (count(p) - CAST(sum(p) AS DOUBLE)) / CASE WHEN count(p) > 0 THEN count(p) END AS expected_otd_rate,
  CAST(sum(p) AS DOUBLE) AS expected_late_order_equivalent_count, count(p) - CAST(sum(p) AS DOUBLE) AS expected_on_time_order_equivalent_count,
  count(*) FILTER (risky) AS high_risk_order_count, count(*) FILTER (risky) / count(*) AS high_risk_delivery_exposure_rate,
  count(*) FILTER (segment = 'protect_high_value_at_risk') AS service_protection_queue_count, count(*) FILTER (segment = 'expedite_selectively') AS selective_expedite_review_count,
  count(*) FILTER (segment = 'preserve_service') AS preserve_service_queue_count, count(*) FILTER (segment = 'standard_process') AS standard_process_queue_count,
  count(*) FILTER (segment IN ('protect_high_value_at_risk', 'expedite_selectively')) AS intervention_required_count,
  count(*) FILTER (segment IN ('protect_high_value_at_risk', 'expedite_selectively')) / count(*) AS intervention_load_rate,
  CAST(sum(profit) AS DOUBLE) / count(profit) AS avg_predicted_order_profit,
  CAST(sum(margin) AS DOUBLE) / CASE WHEN count(margin) > 0 THEN count(margin) END AS avg_predicted_margin, CAST(sum(profit) AS DOUBLE) AS total_predicted_profit
FROM wide GROUP BY ALL)"""))
def f3(spark, sf):
    out = logistics.logistics_kpi_summary(
        _full(spark, sf).withColumn("item_net_sales_amount", F.col("Order_Item_Total")))
    return out


@query("f12_order_kpi_detail", O.located(f"""
SELECT Order_Id, Order_Item_Id, order_date_DateOrders, shipping_date_DateOrders, {_DIMS}, CAST(qty AS DOUBLE) AS order_item_quantity,
  CAST(Order_Item_Total AS DOUBLE) AS item_net_sales_amount, CAST(value AS DOUBLE) AS ao3_order_value, planned AS Days_for_shipment_scheduled, actual AS Days_for_shipping_real,
  CAST(planned AS DOUBLE) AS scheduled_shipping_days, CAST(actual AS DOUBLE) AS actual_shipping_lead_time, CAST(actual - planned AS DOUBLE) AS delivery_delay_gap,
  1 AS valid_delivery_metric_flag, CAST(actual <= planned AS INT) AS actual_on_time_delivery_flag, CAST(actual > planned AS INT) AS actual_late_delivery_flag,
  coalesce(Delivery_Status, 'unknown_delivery_status') AS delivery_status_normalized, CAST(p AS DOUBLE) AS ao1_predicted_late_delivery_probability,
  1 - CAST(p AS DOUBLE) AS ao1_expected_on_time_probability, CAST(coalesce(risky, FALSE) AS INT) AS ao1_high_risk_flag,
  CAST(coalesce(risky, FALSE) AND actual > planned AS INT) AS true_positive_flag, CAST(coalesce(risky, FALSE) AND actual <= planned AS INT) AS false_positive_flag,
  CAST(NOT coalesce(risky, FALSE) AND actual > planned AS INT) AS false_negative_flag, CAST(NOT coalesce(risky, FALSE) AND actual <= planned AS INT) AS true_negative_flag,
  CAST(profit AS DOUBLE) AS ao2_predicted_order_profit, margin_d AS ao3_predicted_margin,
  CAST(segment IN ('protect_high_value_at_risk', 'expedite_selectively') AS INT) AS intervention_required_flag FROM wide"""))
def f12(spark, sf):
    return logistics.order_kpi_detail(_full(spark, sf))


@query("d3_kpi_detail_rules", O.scored("""SELECT * FROM (
  SELECT 'null_ao1_predicted_late_delivery_probability' AS rule, count(*) - count(p) AS violations FROM seg
  UNION ALL SELECT 'null_ao3_predicted_margin', count(*) - count(margin) FROM seg) WHERE violations > 0"""))
def d3_detail(spark, sf):
    detail = logistics.order_kpi_detail(_full(spark, sf))
    return contracts.rule_violations(detail, contracts.kpi_detail_rules()).where("violations > 0")


@query("d4_geographic_rules", O.located(f""", f2 AS ({_F2_ROWS}) SELECT * FROM (
  SELECT 'null_ao1_high_risk_flag' AS rule, count(*) FILTER (ao1_high_risk_flag IS NULL) AS violations FROM f2
  UNION ALL SELECT 'range_map_latitude', count(*) FILTER (map_latitude NOT BETWEEN -90 AND 90) FROM f2) WHERE violations > 0"""))
def d4_geo(spark, sf):
    summary = geography.geographic_segment_summary(_placed(spark, sf))
    return contracts.rule_violations(summary, contracts.segment_summary_rules()).where("violations > 0")


@query("d6_forbidden_outcomes", O.located(f"SELECT count(*) AS served_rows FROM ({_F2_ROWS})"))
def d6(spark, sf):
    served = contracts.assert_no_forbidden(geography.geographic_segment_summary(_placed(spark, sf)))
    return served.agg(F.count(F.lit(1)).alias("served_rows"))
