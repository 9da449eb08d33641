"""Risk-by-margin decisions: margin, policy, segments, queues and their benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import mean, ratio, ratio_or_zero
from ..functions.text import _c


def predicted_margin(profit: Column | str = N.EXPECTED_PROFIT, value: Column | str = N.ORDER_VALUE) -> Column:
    """Profit over order value; NULL without a positive value.

    NULL, not NaN: NaN sorts above every number and would pass as a high margin.
    """
    v = _c(value).cast("double")
    return F.when(v > 0, _c(profit).cast("double") / v)


@dataclass(frozen=True)
class MarginPolicy:
    """The two cutoffs and the names of the four operational segments."""

    risk_cutoff: float = N.RISK_CUTOFF
    margin_cutoff: float = N.MARGIN_CUTOFF
    policy_name: str = N.POLICY_NAME
    high_risk_high_margin: str = N.PROTECT
    high_risk_low_margin: str = N.EXPEDITE
    low_risk_high_margin: str = N.PRESERVE
    low_risk_low_margin: str = N.STANDARD

    def as_table(self, spark: SparkSession) -> DataFrame:
        names = list(self.__dataclass_fields__)
        kinds = ["DOUBLE", "DOUBLE", *["STRING"] * 5]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        return spark.createDataFrame([tuple(getattr(self, n) for n in names)], schema)


def _missing(value: Column) -> Column:
    """NULL or NaN."""
    return value.isNull() | F.isnan(value.cast("double"))


def high_risk_flag(threshold: float | Column, risk: Column | str = N.RISK) -> Column:
    return _c(risk) >= threshold


def segment_columns(policy: MarginPolicy = MarginPolicy()) -> dict[str, Column]:
    """Policy echo, the two flags and the segment; missing inputs go to review first."""
    risk, profit, value, margin = (F.col(c) for c in (N.RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN))
    high_risk, high_margin = risk >= policy.risk_cutoff, margin >= policy.margin_cutoff
    by_margin = {
        True: F.when(high_margin, policy.high_risk_high_margin).otherwise(policy.high_risk_low_margin),
        False: F.when(high_margin, policy.low_risk_high_margin).otherwise(policy.low_risk_low_margin),
    }
    return {
        "ao3_policy_name": F.lit(policy.policy_name),
        "ao3_risk_cutoff": F.lit(float(policy.risk_cutoff)),
        "ao3_margin_cutoff": F.lit(float(policy.margin_cutoff)),
        "ao3_high_risk_flag": high_risk,
        N.HIGH_MARGIN: high_margin,
        N.SEGMENT: F.when(_missing(risk) | _missing(profit), N.SCORE_REVIEW)
        .when(_missing(value) | _missing(margin) | (value <= 0), N.MARGIN_REVIEW)
        .when(high_risk, by_margin[True])
        .otherwise(by_margin[False]),
    }


def assign_segments(df: DataFrame, policy: MarginPolicy = MarginPolicy(), stamp: str | None = None) -> DataFrame:
    """Scores to segments.  Row-local, so it runs unchanged on a stream."""
    out = df.withColumns(segment_columns(policy))
    return out.withColumn(stamp, F.current_timestamp()) if stamp else out


# FIXED VALUES: queue label and display order per segment.
QUEUES = {
    N.PROTECT: ("Protect First", 1),
    N.EXPEDITE: ("Review Selective Expedite", 2),
    N.PRESERVE: ("Preserve Service", 3),
    N.STANDARD: ("Standard Process", 4),
}
QUEUE_REST = ("Review Score or Margin", 98)


def lookup(value: Column | str, table: dict, rest) -> Column:
    """Literal look-up with a value for everything else."""
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, _c(value)), F.lit(rest))


def action_queue_columns(segment: Column | str = N.SEGMENT) -> dict[str, Column]:
    return {
        "ao3_action_queue_label": lookup(segment, {s: q[0] for s, q in QUEUES.items()}, QUEUE_REST[0]),
        "ao3_action_queue_sort_order": lookup(segment, {s: q[1] for s, q in QUEUES.items()}, QUEUE_REST[1]),
        "intervention_required_flag": F.coalesce(_c(segment).isin(N.PROTECT, N.EXPEDITE).cast("int"), F.lit(0)),
    }


def confusion_columns(flagged: Column, late: Column, on_time: Column) -> dict[str, Column]:
    """Per-row confusion flags from 0/1 columns; all are 0 where the outcome is unknown."""
    missed = 1 - flagged
    return {
        "true_positive_flag": flagged * late, "false_positive_flag": flagged * on_time,
        "false_negative_flag": missed * late, "true_negative_flag": missed * on_time,
    }


def _signal_means() -> list[Column]:
    return [mean(c).alias(f"avg_{c}") for c in (N.RISK, N.EXPECTED_PROFIT, N.MARGIN)]


def segment_summary(df: DataFrame, segments: Sequence[str] = N.SEGMENTS) -> DataFrame:
    """Size, share and mean signals of every segment, those without rows included."""
    found = df.groupBy(N.SEGMENT).agg(F.count(F.lit(1)).alias("row_count"), *_signal_means())
    # At most one row per segment name; the total is summed over those few rows.
    found = found.withColumn("_total", F.sum("row_count").over(Window.partitionBy(F.lit(1))))
    every = df.sparkSession.createDataFrame([(s,) for s in segments], f"{N.SEGMENT} STRING")
    return every.join(found, N.SEGMENT, "left").select(
        N.SEGMENT,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce(F.try_divide(F.col("row_count"), F.col("_total")), F.lit(0.0)).alias("share_of_rows"),
        *[f"avg_{c}" for c in (N.RISK, N.EXPECTED_PROFIT, N.MARGIN)],
    )


def single_signal_columns() -> dict[str, Column]:
    """What prioritizing by risk alone, or by margin alone, would lump together."""
    seg = F.col(N.SEGMENT)
    return {
        "risk_only_group": F.when(seg == N.SCORE_REVIEW, seg)
        .when(F.col("ao3_high_risk_flag"), "high_risk").otherwise("low_risk"),
        "margin_only_group": F.when(seg == N.MARGIN_REVIEW, seg)
        .when(F.col(N.HIGH_MARGIN), "high_margin").otherwise("low_margin"),
    }


def share_of_group(df: DataFrame, group: Sequence[str], n: str, name: str) -> DataFrame:
    """Share of each (already aggregated) row in its group's total."""
    whole = F.sum(n).over(Window.partitionBy(*group))
    return df.withColumn(name, F.col(n) / whole)


def single_signal_crosswalk(df: DataFrame) -> DataFrame:
    """How each single-signal group splits over the segments, both signals in one pass."""
    groups = single_signal_columns()
    tagged = df.select(
        N.SEGMENT, N.RISK, N.EXPECTED_PROFIT, N.MARGIN,
        F.explode(
            F.array(
                F.struct(F.lit("risk_only").alias("s"), groups["risk_only_group"].alias("g")),
                F.struct(F.lit("margin_only").alias("s"), groups["margin_only_group"].alias("g")),
            )
        ).alias("x"),
    )
    keys = ["priority_signal", "single_signal_group"]
    counted = tagged.groupBy(
        F.col("x.s").alias(keys[0]), F.col("x.g").alias(keys[1]), N.SEGMENT
    ).agg(F.count(F.lit(1)).alias("row_count"), *_signal_means())
    out = share_of_group(counted, keys, "row_count", "share_of_single_signal_group")
    return out.select(*keys, N.SEGMENT, "row_count", "share_of_single_signal_group",
                      *[f"avg_{c}" for c in (N.RISK, N.EXPECTED_PROFIT, N.MARGIN)])


# FIXED VALUES: meaning of each benchmark metric.
INSIGHT_NOTES = {
    "total_scored_orders": "Benchmark population size from the AO3 held-out segment table.",
    "high_risk_orders": "Orders that risk-only prioritization would group together.",
    "high_risk_share_high_margin": "Share of high-risk orders that AO3 separates as high-margin protection priorities.",
    "high_risk_share_low_margin": "Share of high-risk orders that AO3 separates as selective-expedite candidates.",
    "high_margin_orders": "Orders that margin-only prioritization would group together.",
    "high_margin_share_high_risk": "Share of high-margin orders that AO3 elevates because delivery risk is also high.",
    "high_margin_share_low_risk": "Share of high-margin orders that AO3 keeps in preserve-service rather than urgent intervention.",
}


def benchmark_insights(df: DataFrame) -> DataFrame:
    """Totals and conditional shares from one aggregation."""
    groups = single_signal_columns()
    seg = F.col(N.SEGMENT)
    counts = df.select(seg, *[e.alias(n) for n, e in groups.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("risk_only_group") == "high_risk").alias("risky"),
        F.count_if(F.col("margin_only_group") == "high_margin").alias("rich"),
        *[F.count_if(seg == s).alias(s) for s in (N.PROTECT, N.EXPEDITE, N.PRESERVE)],
    )
    c = F.col
    values = {
        "total_scored_orders": c("n").cast("double"),
        "high_risk_orders": c("risky").cast("double"),
        "high_risk_share_high_margin": ratio_or_zero(c(N.PROTECT), c("risky")),
        "high_risk_share_low_margin": ratio_or_zero(c(N.EXPEDITE), c("risky")),
        "high_margin_orders": c("rich").cast("double"),
        "high_margin_share_high_risk": ratio_or_zero(c(N.PROTECT), c("rich")),
        "high_margin_share_low_risk": ratio_or_zero(c(N.PRESERVE), c("rich")),
    }
    rows = [
        F.struct(F.lit(n).alias("metric_name"), e.alias("metric_value"), F.lit(INSIGHT_NOTES[n]).alias("decision_relevance"))
        for n, e in values.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


# FIXED VALUES: why a threshold was chosen, best reason first.
SELECTION_REASONS = (
    "meets_recall_and_alert_rate_constraints",
    "fallback_max_recall_under_alert_rate_cap",
    "fallback_best_f1_no_alert_rate_constraint_met",
)


def preferred_model(metrics: DataFrame, preferred: str) -> tuple[str, bool]:
    """The preferred model if it was evaluated, else the best by ROC AUC, then PR AUC."""
    best = metrics.orderBy(
        (F.col("model_name") == preferred).desc(), F.desc("roc_auc"), F.desc("pr_auc")
    ).select("model_name").first()
    if best is None:
        raise ValueError("no evaluated model")
    return best[0], best[0] == preferred


def select_threshold(
    grid: DataFrame, min_recall: float = N.MIN_RECALL, max_alert_rate: float = N.MAX_ALERT_RATE
) -> DataFrame:
    """Operating threshold of each model in the grid, with the reason for the choice.

    Rows fall into three tiers by the constraints they meet.  The first two rank by
    recall, precision, f1 and threshold, the last by f1 first.
    """
    calm = F.col("predicted_positive_rate") <= max_alert_rate
    tier = F.when(calm & (F.col("recall") >= min_recall), 0).when(calm, 1).otherwise(2)
    recall, precision, f1, threshold = (F.col(c) for c in ("recall", "precision", "f1", "threshold"))
    merit = F.when(tier < 2, F.array(recall, precision, f1, threshold)).otherwise(
        F.array(f1, recall, precision, threshold))
    # Tier negated so that one ``max_by`` finds the best row without a window.
    best = grid.groupBy("model_name").agg(
        F.max_by(F.struct(tier.alias("tier"), *[F.col(c) for c in grid.columns if c != "model_name"]),
                 F.struct((-tier).alias("t"), merit.alias("m"))).alias("b")
    )
    reasons = F.array(*[F.lit(r) for r in SELECTION_REASONS])
    return best.select(
        "model_name",
        F.col("b.threshold").alias("selected_threshold"),
        F.element_at(reasons, F.col("b.tier") + 1).alias("selection_reason"),
        F.lit(float(min_recall)).alias("minimum_recall_target"),
        F.lit(float(max_alert_rate)).alias("maximum_alert_rate_target"),
        F.col("b.row_count").alias("validation_row_count"),
        *[F.col(f"b.{c}").alias(f"validation_{c}") for c in (
            "positive_class_rate", "predicted_positive_rate", "precision", "recall", "f1",
            "true_negative", "false_positive", "false_negative", "true_positive")],
    )


def attach_recommendations(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Operational recommendation of each row's segment (one matrix row per segment)."""
    return df.join(matrix, N.SEGMENT, "left")
