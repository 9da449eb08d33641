"""Business measures, trends, queues and hotspots."""

from pyspark.sql import functions as F

from .. import names as N
from ..operators import geography, measures as M
from ..operators.features import customer_regional_columns
from . import oracle as O
from .orders import segments
from .q_serving import _COUNTS, _WHERE
from .registry import doubles, query

# Reference SQL of each measure, over the segment view.
_D = {
    "total_items": "count(*)",
    "high_risk_items": "count(*) FILTER (risky)",
    "high_risk_rate": "count(*) FILTER (risky) / count(*)",
    "low_risk_items": "count(*) - count(*) FILTER (risky)",
    "low_risk_rate": "(count(*) - count(*) FILTER (risky)) / count(*)",
    "expected_profit": "CAST(sum(profit) AS DOUBLE)",
    "average_expected_profit": "CAST(sum(profit) AS DOUBLE) / count(profit)",
    "total_order_value": "CAST(sum(value) AS DOUBLE)",
    "expected_profit_margin": "CAST(sum(profit) AS DOUBLE) / CAST(sum(value) AS DOUBLE)",
    "average_late_risk": "CAST(sum(p) AS DOUBLE) / count(p)",
    "average_predicted_margin": "CAST(sum(margin) AS DOUBLE) / count(margin)",
    "risk_cutoff": "CAST(0.35 AS DOUBLE)",
    "margin_cutoff": "CAST(0 AS DOUBLE)",
    "negative_profit_items": "count(*) FILTER (profit < 0)",
    "negative_profit_rate": "count(*) FILTER (profit < 0) / count(*)",
    "positive_profit_items": "count(*) - count(*) FILTER (profit < 0)",
    "positive_profit_rate": "(count(*) - count(*) FILTER (profit < 0)) / count(*)",
    "negative_profit_exposure": "abs(CAST(sum(profit) FILTER (profit < 0) AS DOUBLE))",
    "protect_items": "count(*) FILTER (segment = 'protect_high_value_at_risk')",
    "expedite_items": "count(*) FILTER (segment = 'expedite_selectively')",
    "preserve_items": "count(*) FILTER (segment = 'preserve_service')",
    "standard_items": "count(*) FILTER (segment = 'standard_process')",
    "protect_share": "count(*) FILTER (segment = 'protect_high_value_at_risk') / count(*)",
    "expedite_share": "count(*) FILTER (segment = 'expedite_selectively') / count(*)",
    "preserve_share": "count(*) FILTER (segment = 'preserve_service') / count(*)",
    "standard_share": "count(*) FILTER (segment = 'standard_process') / count(*)",
    "protected_value": "CAST(sum(value) FILTER (segment = 'protect_high_value_at_risk') AS DOUBLE)",
    "protected_profit": "CAST(sum(profit) FILTER (segment = 'protect_high_value_at_risk') AS DOUBLE)",
    "protected_value_share": "CAST(sum(value) FILTER (segment = 'protect_high_value_at_risk') AS DOUBLE) / CAST(sum(value) AS DOUBLE)",
    "protected_profit_share": "CAST(sum(profit) FILTER (segment = 'protect_high_value_at_risk') AS DOUBLE) / CAST(sum(profit) AS DOUBLE)",
    "expedite_value": "CAST(sum(value) FILTER (segment = 'expedite_selectively') AS DOUBLE)",
    "expedite_profit": "CAST(sum(profit) FILTER (segment = 'expedite_selectively') AS DOUBLE)",
    "expedite_value_share": "CAST(sum(value) FILTER (segment = 'expedite_selectively') AS DOUBLE) / CAST(sum(value) AS DOUBLE)",
    "average_protect_value": "CAST(sum(value) FILTER (segment = 'protect_high_value_at_risk') AS DOUBLE) / count(*) FILTER (segment = 'protect_high_value_at_risk')",
    "priority_review_items": "count(*) FILTER (segment IN ('protect_high_value_at_risk', 'expedite_selectively'))",
    "priority_review_rate": "count(*) FILTER (segment IN ('protect_high_value_at_risk', 'expedite_selectively')) / count(*)",
    "high_risk_value": "CAST(sum(value) FILTER (risky) AS DOUBLE)",
    "high_risk_value_share": "CAST(sum(value) FILTER (risky) AS DOUBLE) / CAST(sum(value) AS DOUBLE)",
    "high_risk_negative_profit_items": "count(*) FILTER (risky AND profit < 0)",
}


def _sql(names, by="", extra=""):
    cols = ", ".join(f"{_D[n]} AS {n}" for n in names)
    return O.scored(f"SELECT {by + ', ' if by else ''}{cols} FROM seg {extra}" + (f" GROUP BY {by}" if by else ""))


@query("p1_core_kpis", _sql(M.CORE))
def p1(spark, sf):
    return M.measure_set(segments(spark, sf), M.CORE)


@query("p1_core_kpis_by_mode", _sql(M.CORE, by="Shipping_Mode"))
def p1_by(spark, sf):
    return M.measure_set(segments(spark, sf), M.CORE, ["Shipping_Mode"])


@query("p4_profit_sign", _sql(M.PROFIT_SIGN))
def p4(spark, sf):
    return M.measure_set(segments(spark, sf), M.PROFIT_SIGN)


@query("p5_segment_kpis", _sql(M.SEGMENT_KPIS))
def p5(spark, sf):
    return M.measure_set(segments(spark, sf), M.SEGMENT_KPIS)


@query("p5_segment_kpis_by_type", _sql(M.SEGMENT_KPIS, by="Type"))
def p5_by(spark, sf):
    return M.measure_set(segments(spark, sf), M.SEGMENT_KPIS, ["Type"])


@query("p6_high_risk_kpis", _sql(M.HIGH_RISK_KPIS))
def p6(spark, sf):
    return M.measure_set(segments(spark, sf), M.HIGH_RISK_KPIS)


@query("p2_dashboard_qa", O.scored("""SELECT *, rows_missing_segment + rows_missing_risk_score + rows_missing_expected_profit + rows_missing_predicted_margin
  + rows_invalid_probability + rows_nonpositive_value AS issue_rows, 0 AS pass_flag FROM (
  SELECT count(*) - count(segment) AS rows_missing_segment, count(*) - count(p) AS rows_missing_risk_score, count(*) - count(profit) AS rows_missing_expected_profit,
    count(*) - count(margin) AS rows_missing_predicted_margin, count(*) FILTER (p < 0 OR p > 1) AS rows_invalid_probability,
    count(*) FILTER (value <= 0) AS rows_nonpositive_value FROM seg)"""))
def p2(spark, sf):
    return M.dashboard_qa(segments(spark, sf))


_WEEK = "CAST(date_trunc('week', order_date_DateOrders) AS DATE)"


@query("p7_weekly_measures", O.scored(f"SELECT {_WEEK} AS order_week_start, "
       + ", ".join(f"{_D[n]} AS {n}" for n in M.WEEKLY) + f" FROM seg GROUP BY {_WEEK}"))
def p7(spark, sf):
    return M.weekly_measures(segments(spark, sf))


_RUN = f"""w AS (SELECT {_WEEK} AS order_week_start, sum(value) FILTER (segment = 'protect_high_value_at_risk') AS v FROM seg GROUP BY 1),
rr AS (SELECT a.order_week_start, CAST(max(a.v) AS DOUBLE) AS protected_value, CAST(sum(b.v) AS DOUBLE) / CASE WHEN count(b.v) > 0 THEN count(b.v) END AS run_rate_4w
  FROM w a JOIN w b ON b.order_week_start BETWEEN a.order_week_start - 21 AND a.order_week_start GROUP BY 1)"""


@query("g7_run_rate_4w", f"WITH {O.SCORED}, {_RUN} SELECT * FROM rr")
def g7(spark, sf):
    return M.run_rate_4w(segments(spark, sf))


@query("h5_g9_weekly_trend", f"""WITH {O.SCORED}, {_RUN},
m AS (SELECT {_WEEK} AS order_week_start, {", ".join(f"{_D[n]} AS {n}" for n in M.WEEKLY)} FROM seg GROUP BY 1),
top AS (SELECT m.*, run_rate_4w FROM m JOIN rr USING (order_week_start) WHERE protect_items > 0 ORDER BY order_week_start DESC LIMIT 12)
SELECT *, dense_rank() OVER (ORDER BY order_week_start) AS week_rank FROM top""")
def h5(spark, sf):
    return M.weekly_trend(segments(spark, sf))


_PERIOD = ["high_risk_items", "high_risk_rate", "expected_profit", "expected_profit_margin", "total_order_value",
           "protect_items", "protected_value", "expedite_items", "average_protect_value"]
_DELTAS = ["high_risk_rate", "expected_profit_margin"]


def _period_sql():
    def side(name, cond):
        cols = ", ".join(f"{_D[m]} AS {name}_{m}" for m in _PERIOD)
        return f"(SELECT {cols} FROM seg, last WHERE {cond})"

    ts = "order_date_DateOrders"
    changes = ", ".join(
        f"coalesce(current_{m}, 0) - coalesce(prior_{m}, 0) AS {m}_delta" if m in _DELTAS
        else f"CAST(coalesce(current_{m}, 0) - coalesce(prior_{m}, 0) AS DOUBLE) / nullif(CAST(prior_{m} AS DOUBLE), 0) AS {m}_change" for m in _PERIOD)
    return f"""WITH {O.SCORED}, last AS (SELECT max({ts}) AS t FROM seg)
SELECT c.*, p.*, {changes} FROM {side('current', f"{ts} > t - INTERVAL 28 DAY AND {ts} <= t")} c,
  {side('prior', f"{ts} > t - INTERVAL 56 DAY AND {ts} <= t - INTERVAL 28 DAY")} p"""


@query("g8_period_over_period", _period_sql())
def g8(spark, sf):
    return M.period_over_period(segments(spark, sf), _PERIOD, deltas=_DELTAS)


_QUEUE = """Order_Id, Order_Item_Id, order_date_DateOrders, CAST(p AS DOUBLE) AS ao1_predicted_late_delivery_probability, CAST(profit AS DOUBLE) AS ao2_predicted_order_profit,
  CAST(value AS DOUBLE) AS ao3_order_value, margin_d AS ao3_predicted_margin, segment AS ao3_priority_segment"""


@query("h1_review_queue", O.scored(f"SELECT {_QUEUE} FROM seg WHERE risky AND profit < 0 ORDER BY value DESC, p DESC"))
def h1(spark, sf):
    return doubles(M.review_queue(segments(spark, sf)))


@query("h2_loss_queue", O.scored(f"SELECT {_QUEUE} FROM seg WHERE profit < 0 ORDER BY profit"))
def h2(spark, sf):
    return doubles(M.loss_queue(segments(spark, sf)))


@query("h3_top_loss_exposure", O.scored("""
, x AS (SELECT profit AS v, rank() OVER (ORDER BY profit) AS k FROM seg WHERE profit < 0)
SELECT abs(CAST(sum(v) FILTER (k <= 10) AS DOUBLE)) AS top_loss_exposure, abs(CAST(sum(v) AS DOUBLE)) AS negative_profit_exposure,
  abs(CAST(sum(v) FILTER (k <= 10) AS DOUBLE)) / abs(CAST(sum(v) AS DOUBLE)) AS top_loss_concentration FROM x"""))
def h3(spark, sf):
    return M.top_loss_exposure(segments(spark, sf))


@query("h4_top_expedite_value", O.scored("""
, x AS (SELECT value AS v, rank() OVER (ORDER BY value DESC) AS k FROM seg WHERE segment = 'expedite_selectively')
SELECT CAST(sum(v) FILTER (k <= 10) AS DOUBLE) AS top_expedite_value, CAST(sum(v) AS DOUBLE) AS expedite_value,
  CAST(sum(v) FILTER (k <= 10) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top_expedite_value_share FROM x"""))
def h4(spark, sf):
    return M.top_expedite_value(segments(spark, sf))


_F1 = f"""f1 AS (SELECT concat_ws(', ', map_location_state, map_location_region, map_location_country) AS map_location_label, map_location_country, map_location_region,
  map_location_state, map_latitude, map_longitude, geo_coordinates_available, {_COUNTS} FROM (SELECT *, display_country AS map_location_country, {_WHERE} FROM wide) GROUP BY ALL)"""
_HOT = """, h AS (SELECT map_location_country, CAST(sum(high_risk_order_count) AS BIGINT) AS risk_items, CAST(sum(order_item_count) AS BIGINT) AS order_items,
  CAST(sum(high_risk_order_count) AS DOUBLE) / CAST(sum(order_item_count) AS DOUBLE) AS risk_rate FROM f1 GROUP BY 1)"""


def _geo_summary(spark, sf):
    rows = segments(spark, sf, "customer", "place").withColumns(customer_regional_columns())
    return geography.geographic_summary(rows)


@query("h6_volume_hotspots", O.located(f", {_F1}{_HOT} SELECT * FROM (SELECT *, rank() OVER (ORDER BY risk_items DESC) AS hotspot_rank FROM h) WHERE hotspot_rank <= 10"))
def h6(spark, sf):
    return M.hotspots(_geo_summary(spark, sf))


@query("h7_severity_hotspots", O.located(f", {_F1}{_HOT} SELECT * FROM (SELECT *, rank() OVER (ORDER BY risk_rate DESC) AS hotspot_rank FROM h WHERE order_items >= 100) WHERE hotspot_rank <= 10"))
def h7(spark, sf):
    return M.hotspots(_geo_summary(spark, sf), by="rate")


@query("h8_top_categories", "SELECT p_name AS category, count(*) AS row_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def h8(spark, sf):
    from .orders import table

    return M.top_n(table(spark, sf, "part"), "p_name")


@query("p8_geographic_kpis", O.located(f", {_F1}" + """ SELECT count(*) AS geo_locations, count(DISTINCT map_location_country) AS geo_countries,
  count(DISTINCT map_location_region) AS geo_regions, count(DISTINCT map_location_state) AS geo_states, CAST(sum(order_item_count) AS BIGINT) AS geo_order_items,
  CAST(sum(high_risk_order_count) AS BIGINT) AS geo_high_risk_items, CAST(sum(high_risk_order_count) AS DOUBLE) / CAST(sum(order_item_count) AS DOUBLE) AS geo_high_risk_rate,
  CAST(sum(protect_high_value_at_risk_count) AS BIGINT) AS geo_protect_items, CAST(sum(expedite_selectively_count) AS BIGINT) AS geo_expedite_items,
  round(sum(total_order_value), 3) AS geo_order_value, round(sum(total_predicted_profit), 3) AS geo_expected_profit,
  round(sum(total_predicted_profit) / sum(total_order_value), 12) AS geo_expected_margin,
  CAST(count(*) FILTER (geo_coordinates_available = 1) AS DOUBLE) / count(*) AS geo_coordinate_coverage FROM f1"""))
def p8(spark, sf):
    out = M.geographic_kpis(_geo_summary(spark, sf))
    return out.withColumns({"geo_order_value": F.round("geo_order_value", 3), "geo_expected_profit": F.round("geo_expected_profit", 3),
                            "geo_expected_margin": F.round("geo_expected_margin", 12)})


@query("p9_profit_band_distribution", O.scored("""
, bands AS (SELECT * FROM (VALUES ('Negative Profit', 1), ('$0 to $10', 2), ('$10 to $25', 3), ('$25 to $50', 4), ('$50 to $100', 5), ('$100+', 6)) AS t(profit_band, profit_band_sort)),
f AS (SELECT CASE WHEN profit < 0 THEN 'Negative Profit' WHEN profit < 10 THEN '$0 to $10' WHEN profit < 25 THEN '$10 to $25'
  WHEN profit < 50 THEN '$25 to $50' WHEN profit < 100 THEN '$50 to $100' ELSE '$100+' END AS profit_band, count(*) AS n FROM seg GROUP BY 1)
SELECT profit_band, profit_band_sort, coalesce(n, 0) AS item_count, coalesce(n, 0) / (SELECT count(*) FROM seg) AS item_share FROM bands LEFT JOIN f USING (profit_band)"""))
def p9(spark, sf):
    return M.profit_band_distribution(segments(spark, sf))


@query("p9_economic_quadrants", O.scored("SELECT segment AS ao3_priority_segment, " + ", ".join(
    f"{_D[n]} AS {n}" for n in ("total_items", "total_order_value", "expected_profit", "average_predicted_margin"))
    + " FROM seg WHERE segment NOT LIKE 'requires%' GROUP BY 1"))
def p9_quadrants(spark, sf):
    return M.economic_quadrants(segments(spark, sf))


@query("p9_portfolio_mix", _sql(["protect_share", "expedite_share", "preserve_share", "standard_share"]))
def p9_mix(spark, sf):
    return M.portfolio_mix(segments(spark, sf))


@query("g9_dense_rank_weeks", f"""WITH {O.SCORED}, w AS (SELECT {_WEEK} AS order_week_start, count(*) AS total_items FROM seg GROUP BY 1)
SELECT *, dense_rank() OVER (ORDER BY order_week_start) AS week_rank FROM w""")
def g9(spark, sf):
    return M.dense_rank_weeks(M.weekly_measures(segments(spark, sf), ["total_items"]))
