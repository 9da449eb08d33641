from pyspark.sql import functions as F
import pytest

from riskloom import names as N
from riskloom.operators import decisions, geography, measures

SCORES = f"{N.RISK} DOUBLE, {N.EXPECTED_PROFIT} DOUBLE, {N.ORDER_VALUE} DOUBLE, {N.MARGIN} DOUBLE"


def test_segments_at_the_boundaries(spark):
    nan = float("nan")
    cases = [
        ((0.35, 0.0, 10.0, 0.0), N.PROTECT), ((0.35, -1.0, 10.0, -0.1), N.EXPEDITE),
        ((0.3499, 5.0, 10.0, 0.5), N.PRESERVE), ((0.1, -1.0, 10.0, -0.1), N.STANDARD),
        ((None, 1.0, 1.0, 1.0), N.SCORE_REVIEW), ((0.5, None, 1.0, 1.0), N.SCORE_REVIEW),
        ((0.5, 1.0, None, 1.0), N.MARGIN_REVIEW), ((0.5, 1.0, 0.0, 1.0), N.MARGIN_REVIEW),
        ((0.5, 1.0, -3.0, 1.0), N.MARGIN_REVIEW), ((0.5, 1.0, 1.0, nan), N.MARGIN_REVIEW), ((nan, 1.0, 1.0, 1.0), N.SCORE_REVIEW),
    ]
    df = spark.createDataFrame([c for c, _ in cases], SCORES)
    assert [r[N.SEGMENT] for r in decisions.assign_segments(df).collect()] == [s for _, s in cases]


def test_margin_is_null_without_positive_value(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (1.0, -2.0), (1.0, None)], "p DOUBLE, v DOUBLE")
    assert [r[0] for r in df.select(decisions.predicted_margin("p", "v")).collect()] == [0.25, None, None, None]


def test_summary_keeps_empty_segments(spark):
    df = decisions.assign_segments(spark.createDataFrame([(0.9, 1.0, 2.0, 0.5)], SCORES))
    rows = {r[N.SEGMENT]: r for r in decisions.segment_summary(df).collect()}
    assert len(rows) == 6 and rows[N.PROTECT]["share_of_rows"] == 1.0
    assert rows[N.STANDARD]["row_count"] == 0 and rows[N.STANDARD][f"avg_{N.RISK}"] is None


# Published threshold grid of the boosted-tree classifier: threshold, tn, fp, fn, tp.
PUBLISHED = [
    (0.30, 1308, 10574, 312, 15449), (0.35, 10124, 1758, 6035, 9726), (0.40, 10447, 1435, 6347, 9414),
    (0.45, 10675, 1207, 6537, 9224), (0.50, 10733, 1149, 6557, 9204), (0.55, 10764, 1118, 6598, 9163),
    (0.60, 10787, 1095, 6651, 9110), (0.65, 10791, 1091, 6733, 9028), (0.70, 10831, 1051, 6869, 8892),
]


def test_published_grid_selects_the_published_threshold(spark):
    from riskloom.operators.evaluation import CONFUSION, _threshold_metrics

    df = spark.createDataFrame([("m", *r) for r in PUBLISHED], "model_name STRING, threshold DOUBLE, true_negative BIGINT, false_positive BIGINT, false_negative BIGINT, true_positive BIGINT")
    grid = df.select("model_name", "threshold", *[e.alias(n) for n, e in _threshold_metrics(*[F.col(c) for c in CONFUSION]).items()])
    row = decisions.select_threshold(grid).first()
    assert row["selected_threshold"] == 0.35 and row["selection_reason"] == "fallback_max_recall_under_alert_rate_cap"
    assert row["validation_precision"] == pytest.approx(0.8469174503657262) and row["validation_f1"] == pytest.approx(0.7139658652963846)
    assert decisions.select_threshold(grid, 0.5, 0.65).first()["selection_reason"] == "meets_recall_and_alert_rate_constraints"
    none = decisions.select_threshold(grid, 0.7, 0.1).first()
    assert none["selection_reason"].startswith("fallback_best_f1") and none["selected_threshold"] == 0.30


def test_published_segment_counts_give_the_published_insights(spark):
    sizes = {N.PROTECT: 13752, N.PRESERVE: 20603, N.EXPEDITE: 52, N.STANDARD: 60}
    score = {N.PROTECT: (0.8, 1.0, 2.0, 0.5), N.PRESERVE: (0.1, 1.0, 2.0, 0.5), N.EXPEDITE: (0.8, -1.0, 2.0, -0.5), N.STANDARD: (0.1, -1.0, 2.0, -0.5)}
    df = None
    for s, n in sizes.items():
        part = spark.range(n).select(*[F.lit(v).alias(c) for c, v in zip((N.RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN), score[s])])
        df = part if df is None else df.unionByName(part)
    got = {r["metric_name"]: r["metric_value"] for r in decisions.benchmark_insights(decisions.assign_segments(df)).collect()}
    assert got["high_risk_orders"] == 13804 and got["high_margin_orders"] == 34355
    assert got["high_risk_share_high_margin"] == pytest.approx(0.9962329759490003)
    assert got["high_margin_share_low_risk"] == pytest.approx(0.599708921554359)


def test_top_k_keeps_ties_at_the_edge(spark):
    rows = [(0.9, -1.0, 10.0, -0.1)] * 3 + [(0.9, -5.0, 10.0, -0.5)]
    df = decisions.assign_segments(spark.createDataFrame(rows, SCORES)).withColumn(N.HIGH_RISK, F.lit(True))
    row = measures.top_loss_exposure(df, k=2).first()
    assert row["top_loss_exposure"] == 8.0 and row["top_loss_concentration"] == 1.0


def test_period_windows_are_open_on_the_left(spark):
    import datetime as dt

    last = dt.datetime(2020, 3, 1)
    rows = [(last - dt.timedelta(days=d), 0.9, 1.0, 10.0, 0.1) for d in (0, 27, 28, 55, 56)]
    df = spark.createDataFrame(rows, f"{N.ORDER_TS} TIMESTAMP, " + SCORES).withColumn(N.HIGH_RISK, F.lit(True))
    row = measures.period_over_period(decisions.assign_segments(df), ["high_risk_items", "total_order_value"]).first()
    assert (row["current_high_risk_items"], row["prior_high_risk_items"], row["high_risk_items_change"]) == (2, 2, 0.0)
    assert row["current_total_order_value"] == 20.0


def test_run_rate_averages_the_weeks_present(spark):
    import datetime as dt

    monday = dt.datetime(2020, 1, 6)
    rows = [(monday + dt.timedelta(weeks=w), 0.9, 1.0, v, 0.1) for w, v in ((0, 10.0), (1, 20.0), (4, 60.0))]
    df = decisions.assign_segments(spark.createDataFrame(rows, f"{N.ORDER_TS} TIMESTAMP, " + SCORES))
    got = [r["run_rate_4w"] for r in measures.run_rate_4w(df).orderBy("order_week_start").collect()]
    assert got == [10.0, 15.0, 40.0]


def test_tier_cutoffs_of_nothing_are_zero(spark):
    df = spark.createDataFrame([], "avg_ao3_predicted_margin DOUBLE, total_order_value DOUBLE, high_risk_order_rate DOUBLE")
    assert set(geography.tier_cutoffs(df).values()) == {0.0}


def test_tier_cutoffs_are_exact_for_any_number_of_rows(spark):
    n = 1_200_000
    value = (F.col("id") * 7919 % n + 1).cast("double")
    df = spark.range(n).select(value.alias("avg_ao3_predicted_margin"), value.alias("total_order_value"), value.alias("high_risk_order_rate"))
    want = {"margin_low": 0.5, "margin_high": 0.75, "exposure_low": 0.25, "exposure_high": 0.75, "risk_low": 0.33, "risk_high": 0.67}
    assert geography.tier_cutoffs(df) == {k: float(round(p * n)) for k, p in want.items()}


def test_top_values_read_their_rows_once(spark):
    """The edge of the ten largest and the sums each computed the scored rows."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(N.EXPEDITE, float(i)) for i in range(40)], f"{N.SEGMENT} STRING, {N.ORDER_VALUE} DOUBLE")
    row = measures.top_expedite_value(rows.mapInArrow(told, rows.schema), 3).first()
    assert (row["top_expedite_value"], row["expedite_value"]) == (37 + 38 + 39, sum(range(40)))
    assert seen.value == 40
