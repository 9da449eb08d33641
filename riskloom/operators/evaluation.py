"""Model evaluation over long prediction tables (one row per model and order item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import mean, ratio, ratio_or_zero
from ..functions.bands import calibration_bin, calibration_label
from ..session import materialize
from .ordering import join_null_safe, exact_quantiles, quantile_columns, running_totals

MODEL, PROBABILITY, PREDICTION = "model_name", "predicted_probability", "predicted_profit"
CONFUSION = ("true_negative", "false_positive", "false_negative", "true_positive")


def _threshold_metrics(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    n = tn + fp + fn + tp
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return {
        "row_count": n,
        "positive_class_rate": ratio(tp + fn, n),
        "predicted_positive_rate": ratio(tp + fp, n),
        "accuracy": ratio_or_zero(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": ratio_or_zero(2 * precision * recall, precision + recall),
        "true_negative": tn, "false_positive": fp, "false_negative": fn, "true_positive": tp,
    }


def threshold_grid(
    predictions: DataFrame, grid: Sequence[float] = N.THRESHOLD_GRID, target: str = N.LATE
) -> DataFrame:
    """Confusion counts and metrics of each model at each threshold.

    Rows are not repeated per threshold: each is counted once in the interval its
    probability falls into, and the few interval counts are accumulated afterwards.
    """
    cuts = sorted(float(t) for t in grid)
    p, y = F.col(PROBABILITY), F.col(target)
    reached = sum(((p >= t).cast("int") for t in cuts[1:]), (p >= cuts[0]).cast("int"))
    per_interval = predictions.groupBy(MODEL, reached.alias("reached")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)]))
    flagged = F.col("reached") > F.col("i")
    counts = per_interval.select(MODEL, "reached", "pos", "neg", at.alias("at")).select(MODEL, "reached", "pos", "neg", "at.*")
    counts = counts.groupBy(MODEL, "threshold").agg(
        F.sum(F.when(flagged, 0).otherwise(F.col("neg"))).alias("true_negative"),
        F.sum(F.when(flagged, F.col("neg")).otherwise(0)).alias("false_positive"),
        F.sum(F.when(flagged, 0).otherwise(F.col("pos"))).alias("false_negative"),
        F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("true_positive"),
    )
    metrics = _threshold_metrics(*[F.col(c) for c in CONFUSION])
    return counts.select(MODEL, "threshold", *[e.alias(n) for n, e in metrics.items()])


def score_counts(predictions: DataFrame, target: str = N.LATE) -> DataFrame:
    """Positives and negatives at each distinct score with inclusive totals from the top.

    Ties collapse before anything is ordered; the running sums cross slice borders
    through slice totals (see ``running_totals``), so no task sees a whole model.
    """
    y = F.col(target)
    per_score = predictions.groupBy(MODEL, F.col(PROBABILITY).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return running_totals(per_score, [MODEL], [F.desc("score")], ["pos", "neg"])


def _class_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy(MODEL).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))


def _curve(predictions: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    scores = materialize(score_counts(predictions, target), "scores")
    totals = _class_totals(scores)
    return join_null_safe(scores, totals, [MODEL]), totals


def roc_curve(predictions: DataFrame, target: str = N.LATE) -> DataFrame:
    """ROC points: one per distinct score, and the empty prediction at infinity."""
    points, totals = _curve(predictions, target)
    shown = points.select(
        MODEL, ratio_or_zero(F.col("neg_upto"), F.col("n")).alias("false_positive_rate"),
        ratio_or_zero(F.col("pos_upto"), F.col("p")).alias("true_positive_rate"), F.col("score").alias("threshold"))
    origin = totals.select(MODEL, F.lit(0.0).alias("false_positive_rate"), F.lit(0.0).alias("true_positive_rate"),
                           F.lit(float("inf")).alias("threshold"))
    return shown.unionByName(origin)


def pr_curve(predictions: DataFrame, target: str = N.LATE) -> DataFrame:
    """Precision-recall points; precision of the empty prediction is 1."""
    points, totals = _curve(predictions, target)
    shown = points.select(
        MODEL, ratio_or_zero(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto")).alias("precision"),
        ratio_or_zero(F.col("pos_upto"), F.col("p")).alias("recall"), F.col("score").alias("threshold"))
    origin = totals.select(MODEL, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                           F.lit(float("inf")).alias("threshold"))
    return shown.unionByName(origin)


def ranking_metrics(predictions: DataFrame, target: str = N.LATE) -> DataFrame:
    """ROC AUC (trapezoid) and average precision per model.

    Twice the area under the step between two scores is ``neg * (2 * pos_upto - pos)``
    in whole counts, so the AUC is one exact integer sum and a division.
    """
    points, _ = _curve(predictions, target)
    wide = "decimal(38,0)"
    twice = F.col("neg").cast("decimal(19,0)") * (2 * F.col("pos_upto") - F.col("pos")).cast("decimal(19,0)")
    step = F.col("pos") * ratio_or_zero(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto"))
    return points.groupBy(MODEL).agg(
        ratio_or_zero(F.sum(twice.cast(wide)), 2.0 * F.max("p") * F.max("n")).alias("roc_auc"),
        ratio_or_zero(F.sum(step), F.max("p")).alias("pr_auc"),
    )


def log_loss(predictions: DataFrame, target: str = N.LATE, epsilon: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col(PROBABILITY).cast("double"), F.lit(1.0 - epsilon)), F.lit(epsilon))
    loss = -F.ln(F.when(F.col(target) == 1, p).otherwise(1.0 - p))
    return predictions.groupBy(MODEL).agg(F.avg(loss).alias("log_loss"))


def classification_metrics(predictions: DataFrame, threshold: float = 0.5, target: str = N.LATE) -> DataFrame:
    """One comparison row per model: threshold metrics, ranking metrics and log loss."""
    # Read three times: stored, as the inputs may be joins of large tables.
    rows = materialize(predictions.select(MODEL, target, PROBABILITY), "predictions")
    at = threshold_grid(rows, [threshold], target)
    return join_null_safe(join_null_safe(at, ranking_metrics(rows, target), [MODEL]), log_loss(rows, target), [MODEL])


def calibration(predictions: DataFrame, target: str = N.LATE) -> DataFrame:
    """Mean prediction and actual rate per probability bin; empty bins are left out."""
    b = calibration_bin(F.col(PROBABILITY))
    out = predictions.groupBy(MODEL, b.alias("bin_number")).agg(
        F.count(F.lit(1)).alias("row_count"),
        mean(PROBABILITY).alias("average_predicted_probability"),
        mean(target).alias("actual_positive_rate"),
    )
    return out.select(MODEL, calibration_label("bin_number").alias("probability_bin"), "row_count",
                      "average_predicted_probability", "actual_positive_rate")


# --- regression -------------------------------------------------------------
def with_errors(predictions: DataFrame, target: str = N.PROFIT) -> DataFrame:
    """Residual (actual minus predicted) and absolute error in double precision."""
    a, p = F.col(target).cast("double"), F.col(PREDICTION).cast("double")
    return predictions.withColumns({"residual": a - p, "absolute_error": F.abs(a - p)})


def _wrong_sign(target: str) -> Column:
    a, p = F.col(target).cast("double"), F.col(PREDICTION).cast("double")
    return ratio(F.count_if(F.signum(a) != F.signum(p)), F.count(F.lit(1)))


def _sample_std(value: Column) -> Column:
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def regression_metrics(predictions: DataFrame, target: str = N.PROFIT) -> DataFrame:
    """RMSE, MAE, R2, median absolute error, bias and sign errors per model."""
    rows = materialize(with_errors(predictions.select(MODEL, target, PREDICTION), target), "errors")
    a, p, r = F.col(target).cast("double"), F.col(PREDICTION).cast("double"), F.col("residual")
    n = F.count(F.lit(1))
    squares, spread = F.sum(r * r), F.var_pop(a) * n
    out = rows.groupBy(MODEL).agg(
        n.alias("validation_rows"),
        F.sqrt(squares / n).alias("rmse"),
        F.avg("absolute_error").alias("mae"),
        F.when(spread > 0, 1.0 - squares / spread).otherwise(0.0).alias("r2"),
        F.avg(r).alias("mean_error"),
        F.avg(a).alias("target_mean"), _sample_std(a).alias("target_std"),
        F.avg(p).alias("prediction_mean"), _sample_std(p).alias("prediction_std"),
        _wrong_sign(target).alias("wrong_profit_sign_share"),
    )
    median = quantile_columns(rows, [MODEL], "absolute_error", {"median_absolute_error": 0.5})
    return join_null_safe(out, median, [MODEL])


RESIDUAL_PROBS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def residual_diagnostics(predictions: DataFrame, target: str = N.PROFIT) -> DataFrame:
    """Residual moments and the quantiles of residual and absolute error per model."""
    rows = materialize(with_errors(predictions.select(MODEL, target, PREDICTION), target), "errors")
    r = F.col("residual")
    moments = rows.groupBy(MODEL).agg(
        F.count(F.lit(1)).alias("validation_rows"), F.avg(r).alias("residual_mean"),
        _sample_std(r).alias("residual_standard_deviation"),
        F.min(r).alias("residual_min"), F.max(r).alias("residual_max"),
        _wrong_sign(target).alias("wrong_profit_sign_share"),
    )
    # Both measures share one ordered layout.
    long = rows.select(
        MODEL, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v"))
                                  for m in ("residual", "absolute_error")])))
    q = exact_quantiles(long, [MODEL, "measure"], "v", list(RESIDUAL_PROBS.values()))

    def pick(measure: str, p: float) -> Column:
        return F.max(F.when((F.col("measure") == measure) & (F.col("probability") == p), F.col("quantile")))

    quantiles = q.groupBy(MODEL).agg(
        *[pick(m, p).alias(f"{m}_{n}") for m in ("residual", "absolute_error") for n, p in RESIDUAL_PROBS.items()])
    return join_null_safe(moments, quantiles, [MODEL]).withColumn("residual_median", F.col("residual_p50"))


# FIXED VALUES: slice labels.
PROFIT_SLICES = ("extreme_low_profit", "loss_or_negative_profit", "low_positive_profit",
                 "medium_positive_profit", "high_positive_profit", "extreme_high_profit")
QUARTILES = ("q1_lowest_profit", "q2_lower_mid_profit", "q3_upper_mid_profit", "q4_highest_profit")
ERROR_BANDS = ("typical_error_le_p50", "elevated_error_p50_p75", "large_error_p75_p90", "extreme_error_gt_p90")


def profit_cutoffs(df: DataFrame, target: str = N.PROFIT) -> dict[str, float]:
    """Global target quantiles, and those of the non-negative part, in one layout.

    Eight numbers reach the driver; an empty part gives zeros.
    """
    t = F.col(target).cast("double")
    parts = F.when(t >= 0, F.array(F.lit("all"), F.lit("gain"))).otherwise(F.array(F.lit("all")))
    q = exact_quantiles(df.select(F.explode(parts).alias("part"), t.alias("t")), ["part"], "t",
                        [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
    found = {(r["part"], r["probability"]): r["quantile"] for r in q.collect()}
    wanted = {"q05": ("all", 0.05), "q95": ("all", 0.95), "gain50": ("gain", 0.5), "gain75": ("gain", 0.75),
              "e0": ("all", 0.0), "e1": ("all", 0.25), "e2": ("all", 0.5), "e3": ("all", 0.75), "e4": ("all", 1.0)}
    return {n: found.get(k, 0.0) for n, k in wanted.items()}


def actual_profit_band(cuts: dict[str, float], target: str = N.PROFIT) -> Column:
    t = F.col(target).cast("double")
    low, loss, small, medium, high, top = PROFIT_SLICES
    return (
        F.when(t <= cuts["q05"], low).when(t < 0, loss).when(t <= cuts["gain50"], small)
        .when(t <= cuts["gain75"], medium).when(t < cuts["q95"], high).otherwise(top)
    )


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin ``(edge, next]`` of a value; the lowest edge belongs to the first bin.

    Equal edges collapse, as tied values have to share a bin.  NULL stays NULL.
    """
    inner = sorted(set(edges))[1:-1]
    place = F.lit(1)
    for edge in inner:
        place = place + (value > edge).cast("int")
    return place


def quartile_label(cuts: dict[str, float], target: str = N.PROFIT) -> Column:
    """Target quartile; four labels need five different edges, otherwise there is one group."""
    edges = [cuts[f"e{i}"] for i in range(5)]
    if len(set(edges)) < 5:
        return F.lit("all_targets")
    place = right_closed_bin(F.col(target).cast("double"), edges)
    return F.element_at(F.array(*[F.lit(x) for x in QUARTILES]), place)


def error_band_column() -> Column:
    """Needs the model's ``ae50``, ``ae75`` and ``ae90`` on the row."""
    e = F.col("absolute_error")
    a, b, c, d = ERROR_BANDS
    return F.when(e <= F.col("ae50"), a).when(e <= F.col("ae75"), b).when(e <= F.col("ae90"), c).otherwise(d)


def with_error_band(rows: DataFrame) -> DataFrame:
    limits = quantile_columns(rows, [MODEL], "absolute_error", {"ae50": 0.5, "ae75": 0.75, "ae90": 0.9})
    return join_null_safe(rows, materialize(limits, "limits"), [MODEL]).withColumn("absolute_error_band", error_band_column())


def error_slices(predictions: DataFrame, min_rows: int = 100, target: str = N.PROFIT) -> DataFrame:
    """Error metrics by actual-profit band, target quartile and error band, per model."""
    # Read five times below, for the cutoffs, the bands and the two kinds of metrics.
    narrow = materialize(predictions.select(MODEL, target, PREDICTION), "predictions")
    cuts = profit_cutoffs(narrow, target)
    rows = materialize(with_error_band(with_errors(narrow, target)), "errors")
    kinds = {
        "actual_profit_band": actual_profit_band(cuts, target),
        "actual_profit_quantile": quartile_label(cuts, target),
        "absolute_error_band": F.col("absolute_error_band"),
    }
    triple = F.array(*[F.struct(F.lit(k).alias("slice_type"), e.alias("slice_value")) for k, e in kinds.items()])
    long = rows.select(MODEL, target, PREDICTION, "residual", "absolute_error", F.inline(triple))
    # For the medians equal errors of a band triple are counted before anything is tripled or sorted.
    counted = rows.groupBy(MODEL, triple.alias("slices"), "absolute_error").agg(F.count(F.lit(1)).alias("repeats"))
    counted = counted.select(MODEL, "absolute_error", "repeats", F.inline("slices"))
    keys = ["slice_type", "slice_value", MODEL]
    r = F.col("residual")
    n = F.count(F.lit(1))
    out = long.groupBy(*keys).agg(
        n.alias("row_count"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg("absolute_error").alias("mae"),
        F.avg(r).alias("mean_error"), _wrong_sign(target).alias("wrong_profit_sign_share"),
        (n < min_rows).alias("is_unstable_small_slice"),
    )
    medians = quantile_columns(counted, keys, "absolute_error", {"median_absolute_error": 0.5}, "repeats")
    return join_null_safe(out, medians, keys)


def compare_models(metrics: DataFrame, baseline: str, primary: str) -> DataFrame:
    """Improvements of the primary model over the baseline and how strong the evidence is."""
    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col(MODEL) == model, F.col(column)))

    row = metrics.agg(*[
        of(m, c).alias(f"{side}_{c}")
        for side, m in (("baseline", baseline), ("primary", primary)) for c in ("rmse", "mae", "r2")])
    c = F.col
    better = (c("primary_rmse") < c("baseline_rmse")) & (c("primary_mae") < c("baseline_mae"))
    return row.select(
        F.lit(baseline).alias("baseline_model"), F.lit(primary).alias("primary_model"), *row.columns,
        (c("baseline_rmse") - c("primary_rmse")).alias("rmse_improvement"),
        (c("baseline_mae") - c("primary_mae")).alias("mae_improvement"),
        F.when(better, "validation_supported").otherwise("validation_not_supported").alias("hypothesis_decision"),
        F.when(c("primary_r2") > 0.25, "strong").when(c("primary_r2") < 0.05, "limited")
        .otherwise("modest").alias("performance_strength"),
    )


def compare_classifiers(metrics: DataFrame, baseline: str, primary: str) -> DataFrame:
    """ROC AUC and recall of two late-delivery models, and whether the primary one is better in both."""
    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col(MODEL) == model, F.col(column)))

    row = metrics.agg(*[
        of(m, c).alias(f"{side}_{c}") for side, m in (("baseline", baseline), ("primary", primary)) for c in ("roc_auc", "recall")])
    c = F.col
    better = (c("primary_roc_auc") > c("baseline_roc_auc")) & (c("primary_recall") > c("baseline_recall"))
    return row.select(
        F.lit(baseline).alias("baseline_model"), F.lit(primary).alias("primary_model"), *row.columns,
        F.when(better, "validation_supported").otherwise("validation_not_supported").alias("hypothesis_decision"))
