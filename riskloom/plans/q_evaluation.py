"""Model-evaluation queries over the deterministic stand-in predictions."""

from pyspark.sql import functions as F

from .. import names as N
from ..operators import contracts, evaluation as E
from ..operators.ordering import quantile_columns
from . import oracle as O
from .orders import LATE_MODELS, PROFIT_MODELS, late_predictions, profit_predictions
from .q_decisions import _CUTS, grid_sql
from .registry import query, rounded

_GRID_COLUMNS = """model_name, threshold, row_count, positive_class_rate, predicted_positive_rate, accuracy, precision, recall, f1,
  true_negative, false_positive, false_negative, true_positive"""


_FAULTY_LATE = f"""WITH {O.LATE_PREDICTIONS}, clean AS (SELECT Order_Id, Order_Item_Id, order_date_DateOrders, CASE WHEN Order_Id % 10 > 0 THEN model_name END AS m,
  CASE WHEN Order_Id % 11 = 0 THEN NULL WHEN Order_Id % 17 = 0 THEN 2 ELSE y END AS t, CASE WHEN Order_Id % 13 > 0 THEN p END AS p FROM preds),
faulty AS (SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE Order_Id % 7 = 0)"""


@query("m1_check_late_predictions", _FAULTY_LATE + """ SELECT 'duplicate_key' AS rule, count(*) AS violations FROM (SELECT m, Order_Id, Order_Item_Id, order_date_DateOrders FROM faulty GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'null_model_name', count(*) FILTER (m IS NULL) FROM faulty UNION ALL SELECT 'null_Late_delivery_risk', count(*) FILTER (t IS NULL) FROM faulty
UNION ALL SELECT 'null_predicted_probability', count(*) FILTER (p IS NULL) FROM faulty
UNION ALL SELECT 'non_binary_target', count(*) FILTER (t NOT IN (0, 1)) FROM faulty UNION ALL SELECT 'probability_out_of_range', count(*) FILTER (p > 1) FROM faulty""")
def m1_late(spark, sf):
    """Predictions with repeated keys, missing names, targets and scores, and targets of 2."""
    c, key = F.col, F.col(N.ORDER)
    clean = late_predictions(spark, sf).withColumns({
        "model_name": F.when(key % 10 > 0, c("model_name")), "predicted_probability": F.when(key % 13 > 0, c("predicted_probability")),
        N.LATE: F.when(key % 11 == 0, F.lit(None)).when(key % 17 == 0, 2).otherwise(c(N.LATE))})
    return contracts.check_predictions(clean.unionByName(clean.where(key % 7 == 0)), N.LATE, "predicted_probability")


_FAULTY_PROFIT = f"""WITH {O.PROFIT_PREDICTIONS}, clean AS (SELECT Order_Id, Order_Item_Id, order_date_DateOrders, CASE WHEN Order_Id % 10 > 0 THEN model_name END AS m,
  CASE WHEN Order_Id % 11 > 0 THEN a END AS t, CASE WHEN Order_Id % 13 > 0 THEN f END AS f, r + CASE WHEN ae > 100 THEN 1 ELSE 0 END AS r,
  ae + CASE WHEN ae > 200 THEN 1 ELSE 0 END AS ae FROM errs),
faulty AS (SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE Order_Id % 7 = 0)"""


@query("m1_check_profit_predictions", _FAULTY_PROFIT + """ SELECT 'residual_mismatch' AS rule, count(*) FILTER (abs(r - (t - f)) > 1e-4) AS violations FROM faulty
UNION ALL SELECT 'absolute_error_mismatch', count(*) FILTER (abs(ae - abs(t - f)) > 1e-4) FROM faulty UNION ALL SELECT 'null_model_name', count(*) FILTER (m IS NULL) FROM faulty
UNION ALL SELECT 'null_Order_Profit_Per_Order', count(*) FILTER (t IS NULL) FROM faulty UNION ALL SELECT 'null_predicted_profit', count(*) FILTER (f IS NULL) FROM faulty
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT m, Order_Id, Order_Item_Id, order_date_DateOrders FROM faulty GROUP BY ALL HAVING count(*) > 1)""")
def m1_profit(spark, sf):
    """As above, with errors that do not add up where they are large."""
    c, key = F.col, F.col(N.ORDER)
    rows = E.with_errors(profit_predictions(spark, sf))
    clean = rows.withColumns({
        "model_name": F.when(key % 10 > 0, c("model_name")), N.PROFIT: F.when(key % 11 > 0, c(N.PROFIT)),
        "predicted_profit": F.when(key % 13 > 0, c("predicted_profit")),
        "residual": c("residual") + F.when(c("absolute_error") > 100, 1.0).otherwise(0.0),
        "absolute_error": c("absolute_error") + F.when(c("absolute_error") > 200, 1.0).otherwise(0.0)})
    return contracts.check_predictions(clean.unionByName(clean.where(key % 7 == 0)), N.PROFIT, "predicted_profit")


@query("m2_threshold_grid", grid_sql(_CUTS) + f" SELECT {_GRID_COLUMNS} FROM grid")
def m2(spark, sf):
    return E.threshold_grid(late_predictions(spark, sf))


_SCORES = f"""WITH {O.LATE_PREDICTIONS}, s AS (SELECT model_name, p AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM preds GROUP BY 1, 2),
u AS (SELECT *, CAST(sum(pos) OVER (PARTITION BY model_name ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (PARTITION BY model_name ORDER BY score DESC) AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY model_name) AS BIGINT) AS np, CAST(sum(neg) OVER (PARTITION BY model_name) AS BIGINT) AS nn FROM s)"""


@query("m3_roc_curve", _SCORES + """ SELECT model_name, fp / nn AS false_positive_rate, tp / np AS true_positive_rate, score AS threshold FROM u
UNION ALL SELECT DISTINCT model_name, 0, 0, CAST('inf' AS DOUBLE) FROM u""")
def m3(spark, sf):
    return E.roc_curve(late_predictions(spark, sf))


@query("m4_pr_curve", _SCORES + """ SELECT model_name, tp / (tp + fp) AS precision, tp / np AS recall, score AS threshold FROM u
UNION ALL SELECT DISTINCT model_name, 1, 0, CAST('inf' AS DOUBLE) FROM u""")
def m4(spark, sf):
    return E.pr_curve(late_predictions(spark, sf))


_RANKED = """ranked AS (SELECT model_name, round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * max(np) * max(nn)), 10) AS roc_auc,
  round(sum(pos * (tp / (tp + fp))) / max(np), 10) AS pr_auc FROM u GROUP BY 1),
loss AS (SELECT model_name, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 10) AS log_loss FROM preds GROUP BY 1)"""


@query("m3_m4_m5_ranking_and_loss", _SCORES + f", {_RANKED} SELECT * FROM ranked JOIN loss USING (model_name)")
def m3_auc(spark, sf):
    p = late_predictions(spark, sf)
    return rounded(E.ranking_metrics(p).join(E.log_loss(p), "model_name"), ["roc_auc", "pr_auc", "log_loss"], 10)


@query("m6_i9_calibration", f"""WITH {O.LATE_PREDICTIONS},
b AS (SELECT *, greatest(1, (pu + 999) // 1000) AS bin FROM preds)
SELECT model_name, CASE WHEN bin = 1 THEN '(-0.001, 0.1]' ELSE '(' || CAST((bin - 1) / 10 AS VARCHAR) || ', ' || CAST(bin / 10 AS VARCHAR) || ']' END AS probability_bin,
  count(*) AS row_count, CAST(sum(pu) / 10000.0 AS DOUBLE) / count(*) AS average_predicted_probability, CAST(sum(y) AS DOUBLE) / count(*) AS actual_positive_rate
FROM b GROUP BY model_name, bin""")
def m6(spark, sf):
    return E.calibration(late_predictions(spark, sf))


@query("m7_model_comparison", grid_sql("[50]") + _SCORES.replace(f"WITH {O.LATE_PREDICTIONS}", "") + f", {_RANKED}"
       + f" SELECT {', '.join('grid.' + c.strip() for c in _GRID_COLUMNS.split(','))}, roc_auc, pr_auc, log_loss FROM grid JOIN ranked USING (model_name) JOIN loss USING (model_name)")
def m7(spark, sf):
    return rounded(E.classification_metrics(late_predictions(spark, sf)), ["roc_auc", "pr_auc", "log_loss"], 10)


_METRICS = """met AS (SELECT model_name, count(*) AS validation_rows, sqrt(sum(r * r) / count(*)) AS rmse, avg(ae) AS mae,
  1 - sum(r * r) / (var_pop(a) * count(*)) AS r2, avg(r) AS mean_error, avg(a) AS target_mean, stddev_samp(a) AS target_std, avg(f) AS prediction_mean,
  stddev_samp(f) AS prediction_std, count(*) FILTER (sign(a) <> sign(f)) / count(*) AS wrong_profit_sign_share, quantile_cont(ae, 0.5) AS median_absolute_error FROM errs GROUP BY 1)"""
_ROUNDED = ["rmse", "mae", "r2", "mean_error", "target_mean", "target_std", "prediction_mean", "prediction_std", "median_absolute_error"]


def _r(cols, digits=7):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("m8_regression_metrics", f"WITH {O.PROFIT_PREDICTIONS}, {_METRICS} SELECT model_name, validation_rows, wrong_profit_sign_share, {_r(_ROUNDED)} FROM met")
def m8(spark, sf):
    return rounded(E.regression_metrics(profit_predictions(spark, sf)), _ROUNDED, 7)


_Q = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
_DIAG = ["residual_mean", "residual_standard_deviation", "residual_min", "residual_max", "residual_median",
         *[f"{m}_{n}" for m in ("residual", "absolute_error") for n in _Q]]


@query("m9_residual_diagnostics", f"""WITH {O.PROFIT_PREDICTIONS}, d AS (SELECT model_name, count(*) AS validation_rows, avg(r) AS residual_mean,
  stddev_samp(r) AS residual_standard_deviation, min(r) AS residual_min, max(r) AS residual_max, quantile_cont(r, 0.5) AS residual_median,
  {", ".join(f"quantile_cont(r, {q}) AS residual_{n}, quantile_cont(ae, {q}) AS absolute_error_{n}" for n, q in _Q.items())},
  count(*) FILTER (sign(a) <> sign(f)) / count(*) AS wrong_profit_sign_share FROM errs GROUP BY 1)
SELECT model_name, validation_rows, wrong_profit_sign_share, {_r(_DIAG)} FROM d""")
def m9(spark, sf):
    return rounded(E.residual_diagnostics(profit_predictions(spark, sf)), _DIAG, 7)


_SLICES = f"""WITH {O.PROFIT_PREDICTIONS},
g AS (SELECT quantile_cont(a, 0.05) AS q05, quantile_cont(a, 0.95) AS q95, quantile_cont(a, 0.5) FILTER (a >= 0) AS g50, quantile_cont(a, 0.75) FILTER (a >= 0) AS g75,
  quantile_cont(a, 0.25) AS e1, quantile_cont(a, 0.5) AS e2, quantile_cont(a, 0.75) AS e3 FROM preds),
k AS (SELECT model_name, quantile_cont(ae, 0.5) AS a50, quantile_cont(ae, 0.75) AS a75, quantile_cont(ae, 0.9) AS a90 FROM errs GROUP BY 1),
b AS (SELECT errs.*, CASE WHEN a <= q05 THEN 'extreme_low_profit' WHEN a < 0 THEN 'loss_or_negative_profit' WHEN a <= g50 THEN 'low_positive_profit'
    WHEN a <= g75 THEN 'medium_positive_profit' WHEN a < q95 THEN 'high_positive_profit' ELSE 'extreme_high_profit' END AS actual_profit_band,
  CASE WHEN a <= e1 THEN 'q1_lowest_profit' WHEN a <= e2 THEN 'q2_lower_mid_profit' WHEN a <= e3 THEN 'q3_upper_mid_profit' ELSE 'q4_highest_profit' END AS actual_profit_quantile,
  CASE WHEN ae <= a50 THEN 'typical_error_le_p50' WHEN ae <= a75 THEN 'elevated_error_p50_p75' WHEN ae <= a90 THEN 'large_error_p75_p90' ELSE 'extreme_error_gt_p90' END AS absolute_error_band
  FROM errs CROSS JOIN g JOIN k USING (model_name))"""


@query("i6_i7_i8_error_bands", _SLICES + " SELECT model_name, actual_profit_band, actual_profit_quantile, absolute_error_band, count(*) AS row_count FROM b GROUP BY ALL")
def i6(spark, sf):
    p = profit_predictions(spark, sf)
    cuts = E.profit_cutoffs(p)
    rows = E.with_error_band(E.with_errors(p))
    return rows.groupBy("model_name", E.actual_profit_band(cuts).alias("actual_profit_band"),
                        E.quartile_label(cuts).alias("actual_profit_quantile"), "absolute_error_band").agg(F.count(F.lit(1)).alias("row_count"))


@query("m10_error_slices", _SLICES + f""", l AS (SELECT 'actual_profit_band' AS slice_type, actual_profit_band AS slice_value, * FROM b
  UNION ALL SELECT 'actual_profit_quantile', actual_profit_quantile, * FROM b UNION ALL SELECT 'absolute_error_band', absolute_error_band, * FROM b),
z AS (SELECT slice_type, slice_value, model_name, count(*) AS row_count, sqrt(avg(r * r)) AS rmse, avg(ae) AS mae, avg(r) AS mean_error,
  quantile_cont(ae, 0.5) AS median_absolute_error, count(*) FILTER (sign(a) <> sign(f)) / count(*) AS wrong_profit_sign_share, count(*) < 100 AS is_unstable_small_slice FROM l GROUP BY 1, 2, 3)
SELECT slice_type, slice_value, model_name, row_count, wrong_profit_sign_share, is_unstable_small_slice, {_r(["rmse", "mae", "mean_error", "median_absolute_error"])} FROM z""")
def m10(spark, sf):
    return rounded(E.error_slices(profit_predictions(spark, sf)), ["rmse", "mae", "mean_error", "median_absolute_error"], 7)


_SIDES = [(s, m) for s, m in (("baseline", PROFIT_MODELS[1]), ("primary", PROFIT_MODELS[0]))]
_CMP = [f"{s}_{c}" for s, _ in _SIDES for c in ("rmse", "mae", "r2")] + ["rmse_improvement", "mae_improvement"]


@query("m11_compare_models", f"""WITH {O.PROFIT_PREDICTIONS}, {_METRICS}, c AS (SELECT {", ".join(
    f"max({c}) FILTER (model_name = '{m}') AS {s}_{c}" for s, m in _SIDES for c in ("rmse", "mae", "r2"))} FROM met),
x AS (SELECT *, baseline_rmse - primary_rmse AS rmse_improvement, baseline_mae - primary_mae AS mae_improvement FROM c)
SELECT '{PROFIT_MODELS[1]}' AS baseline_model, '{PROFIT_MODELS[0]}' AS primary_model, {_r(_CMP)},
  CASE WHEN primary_rmse < baseline_rmse AND primary_mae < baseline_mae THEN 'validation_supported' ELSE 'validation_not_supported' END AS hypothesis_decision,
  CASE WHEN primary_r2 > 0.25 THEN 'strong' WHEN primary_r2 < 0.05 THEN 'limited' ELSE 'modest' END AS performance_strength FROM x""")
def m11(spark, sf):
    metrics = E.regression_metrics(profit_predictions(spark, sf))
    return rounded(E.compare_models(metrics, PROFIT_MODELS[1], PROFIT_MODELS[0]), _CMP, 7)


@query("p3_validation_kpis", f"""WITH {O.PROFIT_PREDICTIONS}, {_METRICS} SELECT validation_rows, wrong_profit_sign_share, {_r(["rmse", "mae", "r2", "median_absolute_error"])}
FROM met WHERE model_name = '{PROFIT_MODELS[0]}'""")
def p3(spark, sf):
    from ..operators.measures import validation_kpis

    wanted = ["validation_rows", "rmse", "mae", "r2", "median_absolute_error", "wrong_profit_sign_share"]
    return rounded(validation_kpis(E.regression_metrics(profit_predictions(spark, sf)), PROFIT_MODELS[0], wanted),
                   ["rmse", "mae", "r2", "median_absolute_error"], 7)


@query("i3_exact_quantiles_by_type", f"""WITH {O.BASE} SELECT Type, round(quantile_cont(CAST(Order_Item_Total AS DOUBLE), 0.1), 6) AS p10, round(quantile_cont(CAST(Order_Item_Total AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST(Order_Item_Total AS DOUBLE), 0.99), 6) AS p99 FROM oi GROUP BY 1""")
def i0(spark, sf):
    from .orders import silver

    out = quantile_columns(silver(spark, sf), ["Type"], "Order_Item_Total", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return rounded(out, ["p10", "p50", "p99"], 6)


@query("m11_classifier_hypothesis", _SCORES + """, a AS (SELECT model_name, CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (CAST(2 AS DOUBLE) * max(np) * max(nn)) AS auc,
  coalesce(CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE), 0) / max(np) AS recall FROM u GROUP BY 1),
b AS (SELECT * FROM a WHERE model_name = 'ao1_logistic_regression_baseline'), x AS (SELECT * FROM a WHERE model_name = 'ao1_xgboost_classifier')
SELECT b.model_name AS baseline_model, x.model_name AS primary_model, round(b.auc, 9) AS baseline_roc_auc, round(b.recall, 9) AS baseline_recall, round(x.auc, 9) AS primary_roc_auc,
  round(x.recall, 9) AS primary_recall, CASE WHEN x.auc > b.auc AND x.recall > b.recall THEN 'validation_supported' ELSE 'validation_not_supported' END AS hypothesis_decision FROM b CROSS JOIN x""")
def m11_classifiers(spark, sf):
    out = E.compare_classifiers(E.classification_metrics(late_predictions(spark, sf)), LATE_MODELS[1], LATE_MODELS[0])
    return rounded(out, ["baseline_roc_auc", "baseline_recall", "primary_roc_auc", "primary_recall"], 9)
