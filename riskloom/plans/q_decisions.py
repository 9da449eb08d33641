"""Decision-layer queries."""

from pyspark.sql import functions as F

from .. import names as N
from ..functions.calendar import order_time_features
from ..operators import decisions
from ..operators.evaluation import threshold_grid
from . import oracle as O
from .orders import late_predictions, segments, silver, with_scores
from .registry import doubles, query

_MEANS = """CAST(sum(p) AS DOUBLE) / count(p) AS avg_ao1_predicted_late_delivery_probability,
  CAST(sum(profit) AS DOUBLE) / count(profit) AS avg_ao2_predicted_order_profit, CAST(sum(margin) AS DOUBLE) / count(margin) AS avg_ao3_predicted_margin"""


@query("b18_predicted_margin", O.scored("SELECT Order_Id, Order_Item_Id, margin_d AS ao3_predicted_margin FROM scored"))
def b18(spark, sf):
    return doubles(with_scores(silver(spark, sf)).select(N.ORDER, N.ITEM, N.MARGIN))


@query("k3_k4_assign_segments", O.scored("""SELECT Order_Id, Order_Item_Id, order_date_DateOrders, 'ao3_risk_margin_matrix' AS ao3_policy_name,
  CAST(0.35 AS DOUBLE) AS ao3_risk_cutoff, CAST(0 AS DOUBLE) AS ao3_margin_cutoff, CAST(risky AS VARCHAR) AS ao3_high_risk_flag, CAST(rich AS VARCHAR) AS ao3_high_margin_flag,
  segment AS ao3_priority_segment FROM seg"""))
def k3(spark, sf):
    out = segments(spark, sf).select(*N.KEYS, *decisions.segment_columns())
    # Three-valued flags are compared as text.
    return out.withColumns({c: F.col(c).cast("string") for c in ("ao3_high_risk_flag", N.HIGH_MARGIN)})


@query("f4_segment_summary", f"""WITH {O.SCORED},
names AS (SELECT unnest(['expedite_selectively', 'preserve_service', 'protect_high_value_at_risk', 'requires_margin_review',
  'requires_score_review', 'standard_process']) AS segment),
agg AS (SELECT segment, count(*) AS n, {_MEANS} FROM seg GROUP BY segment)
SELECT names.segment AS ao3_priority_segment, coalesce(n, 0) AS row_count, coalesce(n / (SELECT count(*) FROM seg), 0) AS share_of_rows,
  avg_ao1_predicted_late_delivery_probability, avg_ao2_predicted_order_profit, avg_ao3_predicted_margin
FROM names LEFT JOIN agg USING (segment)""")
def f4(spark, sf):
    """Flagship: order items, calendar features, scores, margin, segment, summary."""
    rows = order_time_features(with_scores(silver(spark, sf)))
    return decisions.segment_summary(decisions.assign_segments(rows))


@query("k5_action_queue", O.scored("""SELECT ao3_action_queue_label, ao3_action_queue_sort_order, intervention_required_flag, count(*) AS n FROM (
  SELECT CASE segment WHEN 'protect_high_value_at_risk' THEN 'Protect First' WHEN 'expedite_selectively' THEN 'Review Selective Expedite'
      WHEN 'preserve_service' THEN 'Preserve Service' WHEN 'standard_process' THEN 'Standard Process' ELSE 'Review Score or Margin' END AS ao3_action_queue_label,
    CASE segment WHEN 'protect_high_value_at_risk' THEN 1 WHEN 'expedite_selectively' THEN 2 WHEN 'preserve_service' THEN 3
      WHEN 'standard_process' THEN 4 ELSE 98 END AS ao3_action_queue_sort_order,
    CAST(segment IN ('protect_high_value_at_risk', 'expedite_selectively') AS INT) AS intervention_required_flag FROM seg) GROUP BY ALL"""))
def k5(spark, sf):
    columns = decisions.action_queue_columns()
    return segments(spark, sf).groupBy(*[e.alias(n) for n, e in columns.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("k6_confusion_flags", O.scored("""SELECT Order_Id, Order_Item_Id, CAST(r AND actual > planned AS INT) AS true_positive_flag,
  CAST(r AND actual <= planned AS INT) AS false_positive_flag, CAST(NOT r AND actual > planned AS INT) AS false_negative_flag,
  CAST(NOT r AND actual <= planned AS INT) AS true_negative_flag FROM (SELECT *, coalesce(risky, FALSE) AS r FROM seg)"""))
def k6(spark, sf):
    from ..functions.calendar import delivery_columns

    out = delivery_columns()
    flagged = F.coalesce(F.col(N.HIGH_RISK).cast("int"), F.lit(0))
    flags = decisions.confusion_columns(flagged, out["actual_late_delivery_flag"], out["actual_on_time_delivery_flag"])
    return segments(spark, sf).select(N.ORDER, N.ITEM, *[e.alias(n) for n, e in flags.items()])


_GROUPS = """g AS (SELECT *,
  CASE WHEN segment = 'requires_score_review' THEN segment WHEN risky THEN 'high_risk' ELSE 'low_risk' END AS by_risk,
  CASE WHEN segment = 'requires_margin_review' THEN segment WHEN rich THEN 'high_margin' ELSE 'low_margin' END AS by_margin FROM seg)"""


@query("k7_g4_single_signal_crosswalk", f"""WITH {O.SCORED}, {_GROUPS},
c AS (SELECT 'risk_only' AS priority_signal, by_risk AS single_signal_group, segment AS ao3_priority_segment, count(*) AS row_count, {_MEANS} FROM g GROUP BY 2, 3
  UNION ALL SELECT 'margin_only', by_margin, segment, count(*), {_MEANS} FROM g GROUP BY 2, 3)
SELECT *, CAST(row_count AS DOUBLE) / CAST(sum(row_count) OVER (PARTITION BY priority_signal, single_signal_group) AS DOUBLE) AS share_of_single_signal_group FROM c""")
def k7(spark, sf):
    return decisions.single_signal_crosswalk(segments(spark, sf))


@query("k8_benchmark_insights", f"""WITH {O.SCORED}, {_GROUPS},
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (by_risk = 'high_risk') AS DOUBLE) AS hr, CAST(count(*) FILTER (by_margin = 'high_margin') AS DOUBLE) AS hm,
  count(*) FILTER (segment = 'protect_high_value_at_risk') AS pr, count(*) FILTER (segment = 'expedite_selectively') AS ex,
  count(*) FILTER (segment = 'preserve_service') AS ps FROM g)
SELECT 'total_scored_orders' AS metric_name, n AS metric_value FROM t UNION ALL SELECT 'high_risk_orders', hr FROM t
UNION ALL SELECT 'high_risk_share_high_margin', pr / hr FROM t UNION ALL SELECT 'high_risk_share_low_margin', ex / hr FROM t
UNION ALL SELECT 'high_margin_orders', hm FROM t UNION ALL SELECT 'high_margin_share_high_risk', pr / hm FROM t
UNION ALL SELECT 'high_margin_share_low_risk', ps / hm FROM t""")
def k8(spark, sf):
    return decisions.benchmark_insights(segments(spark, sf)).drop("decision_relevance")


def grid_sql(cuts: str) -> str:
    return f"""WITH {O.LATE_PREDICTIONS}, cuts AS (SELECT unnest({cuts}) AS cu),
c AS (SELECT model_name, cu / 100.0 AS threshold, count(*) FILTER (pu < cu * 100 AND y = 0) AS tn, count(*) FILTER (pu >= cu * 100 AND y = 0) AS fp,
  count(*) FILTER (pu < cu * 100 AND y = 1) AS fn, count(*) FILTER (pu >= cu * 100 AND y = 1) AS tp FROM preds CROSS JOIN cuts GROUP BY 1, 2),
r AS (SELECT *, tn + fp + fn + tp AS n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c),
grid AS (SELECT model_name, threshold, n AS row_count, (tp + fn) / n AS positive_class_rate, (tp + fp) / n AS predicted_positive_rate, (tp + tn) / n AS accuracy,
  pr AS precision, rc AS recall, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1,
  tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive FROM r)"""


_PICK = """ SELECT model_name, threshold AS selected_threshold, reason AS selection_reason, CAST({recall} AS DOUBLE) AS minimum_recall_target,
  CAST({alert} AS DOUBLE) AS maximum_alert_rate_target, row_count AS validation_row_count, positive_class_rate AS validation_positive_class_rate,
  predicted_positive_rate AS validation_predicted_positive_rate, precision AS validation_precision, recall AS validation_recall, f1 AS validation_f1,
  true_negative AS validation_true_negative, false_positive AS validation_false_positive, false_negative AS validation_false_negative,
  true_positive AS validation_true_positive FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY tier, CASE WHEN tier = 3 THEN f1 ELSE recall END DESC,
      CASE WHEN tier = 3 THEN recall ELSE precision END DESC, CASE WHEN tier = 3 THEN precision ELSE f1 END DESC, threshold DESC) AS k,
    ['meets_recall_and_alert_rate_constraints', 'fallback_max_recall_under_alert_rate_cap', 'fallback_best_f1_no_alert_rate_constraint_met'][tier] AS reason
  FROM (SELECT *, CASE WHEN predicted_positive_rate <= {alert} AND recall >= {recall} THEN 1 WHEN predicted_positive_rate <= {alert} THEN 2 ELSE 3 END AS tier FROM grid)) WHERE k = 1"""
_CUTS = "[30, 35, 40, 45, 50, 55, 60, 65, 70]"


@query("k1_select_threshold", grid_sql(_CUTS) + _PICK.format(recall="0.7", alert="0.65"))
def k1(spark, sf):
    return decisions.select_threshold(threshold_grid(late_predictions(spark, sf)))


@query("k1_select_threshold_strict", grid_sql(_CUTS) + _PICK.format(recall="0.99", alert="0.4"))
def k1_strict(spark, sf):
    return decisions.select_threshold(threshold_grid(late_predictions(spark, sf)), min_recall=0.99, max_alert_rate=0.4)


@query("k2_margin_policy", O.scored("""SELECT max(CAST(0.35 AS DOUBLE)) AS risk_cutoff, max(CAST(0 AS DOUBLE)) AS margin_cutoff,
  count(*) FILTER (segment = 'protect_high_value_at_risk') AS high_risk_high_margin_rows FROM seg"""))
def k2(spark, sf):
    policy = decisions.MarginPolicy().as_table(spark)
    rows = segments(spark, sf).join(F.broadcast(policy), F.col(N.SEGMENT) == F.col("high_risk_high_margin"), "left")
    return rows.agg(F.max("risk_cutoff").alias("risk_cutoff"), F.max("margin_cutoff").alias("margin_cutoff"),
                    F.count("high_risk_high_margin").alias("high_risk_high_margin_rows"))


_ACTIONS = {
    N.PROTECT: "Prioritize pre-dispatch protection", N.EXPEDITE: "Review selectively",
    N.PRESERVE: "Maintain standard service quality", N.STANDARD: "Use normal operating procedures",
    N.SCORE_REVIEW: "Review score pipeline completeness", N.MARGIN_REVIEW: "Review margin construction",
}


@query("k10_attach_recommendations", O.scored("SELECT Order_Id, Order_Item_Id, CASE segment "
       + " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in _ACTIONS.items()) + " END AS recommended_action FROM seg"))
def k10(spark, sf):
    matrix = spark.createDataFrame(list(_ACTIONS.items()), f"{N.SEGMENT} STRING, recommended_action STRING")
    return decisions.attach_recommendations(segments(spark, sf), matrix).select(N.ORDER, N.ITEM, "recommended_action")
