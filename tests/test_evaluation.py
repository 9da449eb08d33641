import numpy as np
import pytest

from riskloom import names as N
from riskloom.operators import evaluation as E, profiling as P


def brute_auc(y, p):
    pos, neg = [a for a, t in zip(p, y) if t], [a for a, t in zip(p, y) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_metrics_with_ties_match_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300).tolist()
    p = (np.round(rng.random(300) * 8 + np.array(y)) / 9).tolist()
    df = spark.createDataFrame([("m", t, a) for t, a in zip(y, p)], f"model_name STRING, {N.LATE} INT, predicted_probability DOUBLE")
    row = E.ranking_metrics(df).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p), abs=1e-12)
    area = 0.0
    for s in sorted(set(p), reverse=True):
        tp = sum(t for t, a in zip(y, p) if a >= s)
        area += sum(t for t, a in zip(y, p) if a == s) / sum(y) * tp / sum(a >= s for a in p)
    assert row["pr_auc"] == pytest.approx(area, abs=1e-12)
    assert E.roc_curve(df).count() == len(set(p)) + 1


def test_single_class_and_extreme_probabilities(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 0.0)], f"model_name STRING, {N.LATE} INT, predicted_probability DOUBLE")
    assert E.ranking_metrics(df).first()["roc_auc"] == 0.0
    assert E.log_loss(df).first()["log_loss"] == pytest.approx(-np.log(1e-15) / 2)
    grid = {r["threshold"]: r for r in E.threshold_grid(df, [0.5]).collect()}
    assert grid[0.5]["precision"] == 1.0 and grid[0.5]["recall"] == 0.5


def test_regression_metrics_and_constant_target(spark):
    a, f = [1.0, -2.0, 3.0, 4.0], [1.5, 1.0, 2.0, 4.0]
    df = spark.createDataFrame([("m", x, z) for x, z in zip(a, f)], f"model_name STRING, {N.PROFIT} DOUBLE, predicted_profit DOUBLE")
    row = E.regression_metrics(df).first()
    r = np.array(a) - np.array(f)
    assert row["rmse"] == pytest.approx(np.sqrt((r**2).mean())) and row["median_absolute_error"] == pytest.approx(np.median(abs(r)))
    assert row["r2"] == pytest.approx(1 - (r**2).sum() / ((np.array(a) - np.mean(a)) ** 2).sum())
    assert row["wrong_profit_sign_share"] == 0.25
    flat = spark.createDataFrame([("m", 2.0, 1.0)] * 2, f"model_name STRING, {N.PROFIT} DOUBLE, predicted_profit DOUBLE")
    assert E.regression_metrics(flat).first()["r2"] == 0.0


def test_quartiles_of_a_tied_target_fall_back_to_one_group(spark):
    df = spark.createDataFrame([("m", float(v), 0.0) for v in (1, 1, 1, 1, 5)], f"model_name STRING, {N.PROFIT} DOUBLE, predicted_profit DOUBLE")
    slices = {(r["slice_type"], r["slice_value"]): r["row_count"] for r in E.error_slices(df).collect()}
    assert slices[("actual_profit_quantile", "all_targets")] == 5


def test_quantile_bins_match_qcut(spark):
    import pandas as pd

    values = [1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9]
    df = spark.createDataFrame([("v", float(v)) for v in values], "g STRING, x DOUBLE")
    got = P.quantile_bins(df, ["g"], "x", 5).toPandas().sort_values("x")["bin_number"].tolist()
    want = (pd.qcut(pd.Series(sorted(values)), 5, labels=False, duplicates="drop") + 1).tolist()
    assert got == want
    two = spark.createDataFrame([("v", 0.0)] * 5 + [("v", 1.0)] * 5, "g STRING, x DOUBLE")
    assert P.quantile_bins(two, ["g"], "x", 5).select("bin_number").distinct().count() == pd.qcut(
        pd.Series([0.0] * 5 + [1.0] * 5), 2, labels=False, duplicates="drop").nunique()


def test_profile_classes(spark):
    rows = [(f"2020-01-{i % 28 + 1:02d}", str(i), "ab"[i % 2], None) for i in range(40)]
    df = spark.createDataFrame(rows, "when STRING, num STRING, cat STRING, empty STRING")
    got = {r["variable_name"]: r for r in P.profile(df).collect()}
    assert (got["when"]["status"], got["num"]["status"], got["cat"]["status"], got["empty"]["status"]) == (
        "datetime", "numeric", "categorical", "categorical")
    assert got["num"]["summary_median"] == 19.5 and got["empty"]["missing_rate"] == 1.0 and got["cat"]["unique_values"] == 2


def test_high_cardinality_columns_are_reported_as_skipped(spark):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(300)], f"c STRING, {N.LATE} INT")
    assert P.bivariate_rate(df, ["c"]).where("high_cardinality").count() == df.select("c").distinct().count()
    assert P.bivariate_rate_summary(df, ["c"]).first()["high_cardinality"]


def test_large_and_infinite_values_are_summed(spark):
    from riskloom.functions.aggregates import mean, total

    df = spark.createDataFrame([(1e7, 1.0), (1e12, float("inf")), (0.25, float("nan")), (None, 2.0)], f"{N.MARGIN} DOUBLE, x DOUBLE")
    got = df.agg(mean(N.MARGIN), total(N.MARGIN), total("x"), mean("x")).first()
    assert got[0] == (1e12 + 1e7 + 0.25) / 3 and got[1] == 1e12 + 1e7 + 0.25 and got[2] == got[3] == float("inf")


def test_a_null_model_is_a_model(spark):
    rows = [(m, i % 2, i / 40, float(i % 7), i / 3) for m in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, f"model_name STRING, {N.LATE} INT, predicted_probability DOUBLE, {N.PROFIT} DOUBLE, predicted_profit DOUBLE")
    for out in (E.ranking_metrics(df), E.classification_metrics(df), E.regression_metrics(df), E.residual_diagnostics(df)):
        assert {r["model_name"] for r in out.collect()} == {"a", None}
    assert {r["model_name"] for r in E.error_slices(df).collect()} == {"a", None}
