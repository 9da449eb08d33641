"""Late-delivery and profit models: linear ones on Spark ML, boosted trees in ``boosting``.

Fits run on executors over the training slice; predictions stay DataFrames.  Only
model metadata (coefficients, importances, candidate metrics) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, StructField, StructType

from .. import names as N
from ..functions.aggregates import ratio_or_zero
from ..session import materialize
from . import boosting
from .decisions import high_risk_flag, predicted_margin
from .evaluation import classification_metrics, regression_metrics
from .gold import merge_one_to_one
from .ordering import exact_quantiles
from .split import numbered_after

FEATURES, UNKNOWN = "features", "unknown"
#: Rows of a task that the logistic fit goes over in each of its steps, at most, about.
ROWS_PER_TASK = 250_000


@dataclass(frozen=True)
class FeatureGroups:
    """Predictors by treatment: scaled numbers, plain flags and one-hot categories."""

    numeric: Sequence[str]
    binary: Sequence[str] = field(default_factory=lambda: N.BINARY_FEATURES)
    categorical: Sequence[str] = field(default_factory=lambda: N.CATEGORICAL_FEATURES)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]


LATE_GROUPS = FeatureGroups(N.LATE_NUMERIC)
PROFIT_GROUPS = FeatureGroups(N.PROFIT_NUMERIC)


def check_feature_groups(groups: FeatureGroups, approved: Sequence[str], forbidden: Sequence[str]) -> None:
    """Groups must be disjoint, cover the approved predictors and hold nothing forbidden."""
    names = groups.all
    repeated = sorted({n for n in names if names.count(n) > 1})
    problems = {
        "in several groups": repeated,
        "not grouped": sorted(set(approved) - set(names)),
        "not approved": sorted(set(names) - set(approved)),
        "forbidden": sorted({n for n in names if n.lower() in {f.lower() for f in forbidden}}),
    }
    found = {k: v for k, v in problems.items() if v}
    if found:
        raise ValueError(f"feature groups: {found}")


def feature_group_problems(listed: DataFrame, approved: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Problem rows ``problem, feature_name, detail`` of stored feature groups.

    ``listed`` has ``treatment, feature_name``, the others ``feature_name``.  Groups must be disjoint, cover the
    approved predictors and hold nothing else, and nothing forbidden in any spelling of upper and lower case.
    """
    per_name = listed.groupBy("feature_name").agg(F.array_sort(F.collect_set("treatment")).alias("treatments"))
    names, fine = per_name.select("feature_name"), approved.select("feature_name").distinct()
    low = F.lower("feature_name")
    banned = forbidden.select(low.alias("low")).distinct()
    row = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), "feature_name", detail.alias("detail"))
    nothing = F.lit("")
    return (
        row(per_name.where(F.size("treatments") > 1), "in several groups", F.concat_ws(", ", "treatments"))
        .unionByName(row(fine.join(names, "feature_name", "left_anti"), "not grouped", nothing))
        .unionByName(row(names.join(fine, "feature_name", "left_anti"), "not approved", nothing))
        .unionByName(row(names.withColumn("low", low).join(banned, "low", "left_semi"), "forbidden", nothing))
    )


def prepared(groups: FeatureGroups) -> dict[str, Column]:
    """Types the pipeline expects, in the order of ``groups.all``: doubles, and text with missing categories filled."""
    casts: dict[str, Column] = {c: F.col(c).cast("double") for c in (*groups.numeric, *groups.binary)}
    # Empty text stays a level of its own, but slot names cannot be empty.
    level = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in groups.categorical}
    return casts | {c: F.coalesce(F.nullif(e, F.lit("")), F.lit("(blank)")) for c, e in level.items()}


def prepare(df: DataFrame, groups: FeatureGroups) -> DataFrame:
    return df.withColumns(prepared(groups))


@dataclass(frozen=True)
class Preprocessor:
    """The fitted stages, and the values that they fill numbers and flags with."""

    pipeline: PipelineModel
    medians: dict[str, float]
    modes: dict[str, float]

    @property
    def labels(self) -> list[list[str]]:
        return self.pipeline.stages[5].labelsArray


def _seen(rows: DataFrame, groups: FeatureGroups) -> DataFrame:
    """How often each column has each known value, from one pass: ``slot`` in the order of ``groups.all``, ``value`` or ``label``, ``n``."""
    numbers, columns = [*groups.numeric, *groups.binary], groups.all

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, value, label, n = [], [], [], []
            for i, c in enumerate(columns):
                if i < len(numbers):
                    v = _numbers(batch.column(c))
                    seen, times = np.unique(v[~np.isnan(v)], return_counts=True)
                    value.append(pa.array(seen))
                    label.append(pa.nulls(len(seen), pa.string()))
                else:
                    seen, times = batch.column(c).value_counts().flatten()
                    value.append(pa.nulls(len(seen), pa.float64()))
                    label.append(seen)
                slot.append(pa.array(np.full(len(seen), i, np.int32)))
                n.append(pa.array(times))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in (slot, value, label, n)], ["slot", "value", "label", "n"])

    counted = rows.select(*columns).mapInArrow(count, "slot INT, value DOUBLE, label STRING, n LONG")
    return materialize(counted.groupBy("slot", "value", "label").agg(F.sum("n").alias("n")), "seen")


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles, nulls as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _filled(columns: Sequence[str], outputs: Sequence[str], values: dict[str, float]) -> SQLTransformer:
    """A stage that fills nulls and NaN with a value for each column."""
    fill = ", ".join(f"coalesce(nanvl(`{c}`, CAST(NULL AS DOUBLE)), CAST('{values[c]!r}' AS DOUBLE)) AS `{o}`" for c, o in zip(columns, outputs))
    return SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__")


def fit_preprocessor(train: DataFrame, groups: FeatureGroups) -> Preprocessor:
    """Imputation by exact medians, scaling and one-hot encoding, fitted on the given slice only.

    Categories unseen in the slice become all zeros: they go to the indexer's extra
    bucket, which is the one the encoder drops.  Medians, the most frequent values of flags (the least of equally frequent
    ones) and the categories come from one count of values.
    """
    rows = prepare(train, groups)
    n = rows.count()
    # Spark scales by the sample deviation; the population one is wanted.
    to_population = (n / (n - 1)) ** 0.5 if n > 1 else 1.0

    def tagged(prefix: str, columns: Sequence[str]) -> list[str]:
        return [f"_{prefix}_{c}" for c in columns]

    numeric, binary = tagged("n", groups.numeric), tagged("b", groups.binary)
    index, hot = tagged("i", groups.categorical), tagged("h", groups.categorical)
    seen, columns = _seen(rows, groups), groups.all
    n_numeric, n_numbers = len(numeric), len(numeric) + len(binary)
    found = exact_quantiles(seen.where(F.col("slot") < n_numeric), ["slot"], "value", [0.5], "n").collect()  # one row per column
    medians = {c: 0.0 for c in groups.numeric} | {columns[r["slot"]]: r["quantile"] for r in found}
    most = seen.where((F.col("slot") >= n_numeric) & (F.col("slot") < n_numbers)).groupBy("slot").agg(
        F.max_by("value", F.struct("n", -F.col("value"))).alias("mode")).collect()
    modes = {columns[r["slot"]]: r["mode"] for r in most}
    if unknown := [c for c in groups.binary if c not in modes]:
        raise ValueError(f"no known value of {unknown}")
    # Categories are model metadata; a column with fewer than another has its first one again.
    levels = {r["slot"] - n_numbers: r["l"] for r in seen.where(F.col("label").isNotNull()).groupBy("slot").agg(F.collect_list("label").alias("l")).collect()}
    listed = [tuple(v[k] if k < len(v) else v[0] for _, v in sorted(levels.items())) for k in range(max(map(len, levels.values())))]
    indexer = StringIndexer(inputCols=list(groups.categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc")
    indexer = indexer.fit(train.sparkSession.createDataFrame(listed, ", ".join(f"`{c}` STRING" for c in groups.categorical)))
    stages = [
        _filled(groups.numeric, numeric, medians),
        VectorAssembler(inputCols=numeric, outputCol="_numbers"),
        StandardScaler(withMean=True, withStd=True, inputCol="_numbers", outputCol="_sample_scaled"),
        ElementwiseProduct(scalingVec=Vectors.dense([to_population] * len(numeric)),
                           inputCol="_sample_scaled", outputCol="_scaled"),
        _filled(groups.binary, binary, modes),
        indexer,
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=["_scaled", *binary, *hot], outputCol=FEATURES),
    ]
    return Preprocessor(Pipeline(stages=stages).fit(rows), medians, modes)


def transform(model: Preprocessor, df: DataFrame, groups: FeatureGroups) -> DataFrame:
    """Input columns plus the feature vector."""
    out = model.pipeline.transform(prepare(df, groups))
    return out.select(*df.columns, FEATURES)


#: How vectors lie in files; Arrow knows nothing of vectors.
_VECTOR = StructType([StructField("type", ByteType()), StructField("size", IntegerType()), StructField("indices", ArrayType(IntegerType())),
                      StructField("values", ArrayType(DoubleType()))])


def store_encoded(model: Preprocessor, df: DataFrame, groups: FeatureGroups, keep: Sequence[str], label: str = "encoded") -> DataFrame:
    """``keep`` and the feature vector that ``transform`` gives, stored.

    The vectors are made in Arrow batches, a column at a time, where the stages go row by row through a function each.
    """
    scaler, weights = model.pipeline.stages[2], model.pipeline.stages[3].getScalingVec().toArray()
    mean, deviation = scaler.mean.toArray(), scaler.std.toArray()
    factor = np.where(deviation != 0, 1.0 / np.where(deviation != 0, deviation, 1.0), 0.0)
    fill = [*(model.medians[c] for c in groups.numeric), *(model.modes[c] for c in groups.binary)]
    labels = [pa.array(v, pa.string()) for v in model.labels]
    n_numeric, n_numbers, columns, keep = len(groups.numeric), len(fill), groups.all, list(keep)
    first = np.cumsum([n_numbers, *map(len, labels)])
    width = int(first[-1])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            slot, value = np.zeros((n, len(columns)), np.int32), np.ones((n, len(columns)))
            for i, c in enumerate(columns):
                column = batch.column(f"_{i}")
                if i < n_numbers:
                    v = _numbers(column)
                    v = np.where(np.isnan(v), fill[i], v)
                    value[:, i] = (v - mean[i]) * factor[i] * weights[i] if i < n_numeric else v
                    slot[:, i] = i
                else:
                    at = pc.index_in(column, labels[i - n_numbers]).fill_null(-1).to_numpy(zero_copy_only=False)
                    slot[:, i] = at + first[i - n_numbers]
                    value[:, i] = at >= 0
            held = value != 0
            ends = pa.array(np.concatenate([[0], np.cumsum(held.sum(1))]), pa.int32())
            vectors = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(slot[held])),
                 pa.ListArray.from_arrays(ends, pa.array(value[held]))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), vectors], [*keep, FEATURES])

    as_stored, as_read = (StructType([*(df.schema[c] for c in keep), StructField(FEATURES, t)]) for t in (_VECTOR, VectorUDT()))
    # Columns that are kept stay as they were, also where they are predictors.
    rows = df.select(*keep, *[e.alias(f"_{i}") for i, e in enumerate(prepared(groups).values())])
    return materialize(rows.mapInArrow(encode, as_stored), label, as_read)


def feature_names(model: Preprocessor, groups: FeatureGroups) -> list[str]:
    """Names of the vector's slots, in order."""
    return (
        [f"numeric_continuous__{c}" for c in groups.numeric]
        + [f"binary_flags__{c}" for c in groups.binary]
        # The indexer's extra bucket is the one slot the encoder drops.
        + [f"categorical__{c}_{v}" for c, values in zip(groups.categorical, model.labels) for v in values]
    )


# --- linear models -----------------------------------------------------------
def balanced_weights(df: DataFrame, target: str = N.LATE) -> DataFrame:
    """``class_weight`` giving both classes the same total; weights sum to the row count."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("p")).first()
    n, p = counts["n"], counts["p"]
    if p in (0, n):
        raise ValueError("both classes are needed to fit a classifier")
    return df.withColumn("class_weight", F.when(F.col(target) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))))


def fit_logistic(features: DataFrame, target: str = N.LATE, c: float = 1.0, max_iter: int = 1000, balanced: bool = True):
    """L2 logistic regression; ``c`` is the inverse regularization strength per weighted row."""
    rows = balanced_weights(features, target) if balanced else features.withColumn("class_weight", F.lit(1.0))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("class_weight")).first()
    # Encoded rows are a tenth as large in files as in memory, so the files' splits would make few and large tasks.
    tasks = -(-n // ROWS_PER_TASK)
    if tasks > rows.rdd.getNumPartitions():
        keys = [c for c in N.KEYS if c in rows.columns]
        rows = rows.select(*keys, FEATURES, target, "class_weight").repartition(tasks, *keys)
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=target, weightCol="class_weight", maxIter=max_iter,
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
    ).fit(rows)


def fit_ridge(features: DataFrame, target: str = N.PROFIT, alpha: float = 1.0):
    """Ridge regression minimizing squared error plus ``alpha`` times the squared coefficients.

    Spark averages the squared error and divides the penalty by the label's deviation,
    hence the scaling of ``alpha``.
    """
    rows = features.withColumn(target, F.col(target).cast("double"))
    n, deviation = rows.agg(F.count(target), F.stddev_pop(target)).first()
    return LinearRegression(
        featuresCol=FEATURES, labelCol=target, regParam=alpha * (deviation or 1.0) / n, elasticNetParam=0.0,
        standardization=False,
    ).fit(rows)


def coefficients(spark, model, names: Sequence[str]) -> DataFrame:
    """Coefficient table of a fitted model, largest magnitude first.  One row per feature slot."""
    rows = [(n, float(v)) for n, v in zip(names, model.coefficients)]
    return coefficient_table(spark.createDataFrame(rows, "feature_name STRING, coefficient DOUBLE"))


def coefficient_table(table: DataFrame) -> DataFrame:
    """Magnitude, odds ratio, direction and rank of given ``feature_name, coefficient`` rows, one per feature slot."""
    c = F.col("coefficient")
    rank = F.row_number().over(Window.orderBy(F.desc("absolute_coefficient"), "feature_name"))
    return table.select(
        "feature_name", c, F.abs(c).alias("absolute_coefficient"),
        F.exp(F.greatest(F.least(c, F.lit(700.0)), F.lit(-700.0))).alias("odds_ratio"),
        F.when(c > 0, "positive").when(c < 0, "negative").otherwise("neutral").alias("direction"),
    ).withColumn("coefficient_rank", rank)


# --- boosted trees -------------------------------------------------------------
@dataclass(frozen=True)
class Candidate:
    """One boosted-tree setting of the validation grid."""

    candidate_id: str
    rounds: int
    depth: int
    rate: float
    row_share: float
    feature_share: float
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0

    def setting(self, seed: int = 42) -> boosting.Setting:
        return boosting.Setting(self.rounds, self.depth, self.rate, self.row_share, self.feature_share, self.reg_lambda,
                                self.reg_alpha, self.min_child_weight, seed)


# FIXED VALUES: the two candidate grids.
LATE_CANDIDATES = (
    Candidate("balanced_reference", 200, 3, 0.05, 0.90, 0.90, 1, 1.0, 0.0),
    Candidate("shallower_regularized", 250, 2, 0.04, 0.85, 0.85, 3, 2.0, 0.1),
    Candidate("deeper_conservative", 150, 4, 0.06, 0.90, 0.90, 2, 1.5, 0.0),
)
PROFIT_CANDIDATES = (
    Candidate("conservative_baseline", 200, 3, 0.05, 0.8, 0.8),
    Candidate("slightly_deeper", 250, 4, 0.05, 0.8, 0.8),
    Candidate("faster_learning", 150, 3, 0.10, 0.8, 0.8),
)


def fit_boosted(features: DataFrame, target: str, grid: Sequence[Candidate], seed: int = 42) -> list[boosting.BoostedTrees]:
    """The candidates' ensembles, grown side by side; a classifier weighs positives by the negative-to-positive ratio."""
    late = target == N.LATE
    weight = None
    if late:
        counts = features.agg(F.count_if(F.col(target) == 0).alias("n"), F.count_if(F.col(target) == 1).alias("p")).first()
        weight = F.when(F.col(target) == 1, counts["n"] / counts["p"] if counts["p"] else 1.0).otherwise(1.0)
    keys = [c for c in N.KEYS if c in features.columns]
    return boosting.fit_many(
        features, [c.setting(seed) for c in grid], boosting.LOGISTIC if late else boosting.SQUARED, target, FEATURES, weight,
        F.xxhash64(*keys) if keys else None)


def fit_gbt_classifier(features: DataFrame, candidate: Candidate, target: str = N.LATE, seed: int = 42) -> boosting.BoostedTrees:
    return fit_boosted(features, target, [candidate], seed)[0]


def fit_gbt_regressor(features: DataFrame, candidate: Candidate, target: str = N.PROFIT, seed: int = 42) -> boosting.BoostedTrees:
    return fit_boosted(features, target, [candidate], seed)[0]


def positive_probability() -> Column:
    return vector_to_array(F.col("probability"))[1]


def prediction_rows(
    model, features: DataFrame, target: str, model_name: str, slice_label: str = N.INNER_VALIDATION, threshold: float = 0.5
) -> DataFrame:
    """Scored validation rows in the layout the evaluation operators read."""
    carried = [c for c in (*N.KEYS, N.ROW_NUMBER, N.SPLIT) if c in features.columns]
    scored = model.transform(features)
    out = [F.lit(model_name).alias("model_name"), F.lit(slice_label).alias("evaluation_slice"), *carried, target]
    if target == N.LATE:
        p = positive_probability()
        return scored.select(
            *out, p.alias("predicted_probability"), F.lit(threshold).alias("prediction_threshold"),
            (p >= threshold).cast("int").alias("predicted_label"))
    error = F.col(target).cast("double") - F.col("prediction")
    return scored.select(*out, F.col("prediction").alias("predicted_profit"), error.alias("residual"),
                         F.abs(error).alias("absolute_error"))


def candidate_results(
    train: DataFrame, validation: DataFrame, target: str, grid: Sequence[Candidate], seed: int = 42
) -> tuple[DataFrame, dict]:
    """Validation metrics of every candidate, the chosen one marked, and the fitted models."""
    models = dict(zip([c.candidate_id for c in grid], fit_boosted(train, target, grid, seed)))
    scored = None
    for name, model in models.items():
        rows = prediction_rows(model, validation, target, name)
        scored = rows if scored is None else scored.unionByName(rows)
    return select_candidate(scored, target, [c.candidate_id for c in grid]), models


def select_candidate(scored: DataFrame, target: str, candidates: Sequence[str]) -> DataFrame:
    """Validation metrics of each candidate's predictions, the chosen one marked.

    Classifiers are chosen by ROC AUC, then recall; regressors by RMSE, then MAE; the
    earlier candidate wins a tie.
    """
    late = target == N.LATE
    metrics = (classification_metrics if late else regression_metrics)(scored)
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model_name"))
    merit = [F.desc("roc_auc"), F.desc("recall")] if late else [F.asc("rmse"), F.asc("mae")]
    # One row per candidate.
    place = F.row_number().over(Window.orderBy(*merit, order))
    chosen = metrics.withColumn("selected", place == 1)
    return chosen.withColumnRenamed("model_name", "candidate_id")


def feature_importance(spark, model, names: Sequence[str]) -> DataFrame:
    """Gain importance (mean loss reduction per split, adding up to one), share and rank of every feature slot."""
    rows = [(n, float(v)) for n, v in zip(names, model.gain_importance())]
    return rank_importance(spark.createDataFrame(rows, "feature_name STRING, importance_value DOUBLE"))


def rank_importance(table: DataFrame) -> DataFrame:
    """Share and rank of given importances; equal ones by name.  One row per feature slot."""
    total = F.sum("importance_value").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.orderBy(F.desc("importance_value"), "feature_name"))
    return table.select("feature_name", "importance_value", ratio_or_zero(F.col("importance_value"), total).alias("importance_share"),
                        rank.alias("importance_rank"))


# --- held-out scoring ------------------------------------------------------------
def _scored(model, features: DataFrame, before: int) -> DataFrame:
    """Predictions, with row numbers that go on from ``before`` where the rows have none: narrow rows are put in order."""
    rows = model.transform(features).drop(FEATURES)
    return rows if N.ROW_NUMBER in rows.columns else numbered_after(rows, before)


def score_late(
    model, features: DataFrame, candidate_id: str, threshold: float, model_name: str = "ao1_xgboost_classifier", before: int = 0
) -> DataFrame:
    p = positive_probability()
    return _scored(model, features, before).select(
        *N.KEYS, N.ROW_NUMBER, N.SPLIT, F.lit(model_name).alias("ao1_model_name"),
        F.lit(candidate_id).alias("ao1_selected_candidate"), F.lit("development_refit_test_score").alias("ao1_scoring_mode"),
        p.alias(N.RISK), F.lit(float(threshold)).alias("ao1_decision_threshold"), high_risk_flag(threshold, p).alias(N.HIGH_RISK))


def score_profit(
    model, features: DataFrame, candidate_id: str, model_name: str = "ao2_gradient_boosting_regressor", before: int = 0
) -> DataFrame:
    return _scored(model, features, before).select(
        *N.KEYS, F.col(N.ROW_NUMBER).alias("ao2_chronological_row_number"), F.col(N.SPLIT).alias("ao2_split_partition"),
        F.lit(model_name).alias("ao2_model_name"), F.lit(candidate_id).alias("ao2_selected_candidate"),
        F.lit("development_refit_test_score").alias("ao2_scoring_mode"), F.col("prediction").alias(N.EXPECTED_PROFIT), N.ORDER_VALUE)


def integrate_scores(late: DataFrame, profit: DataFrame, check: bool = True) -> DataFrame:
    """Order items held out for both objectives, with the predicted margin."""
    return merge_one_to_one(late, profit, check=check).withColumn(N.MARGIN, predicted_margin())


def fit_and_score(
    partitioned: DataFrame, target: str, groups: FeatureGroups, candidate: Candidate, threshold: float = N.RISK_CUTOFF
) -> DataFrame:
    """Refit one candidate on development and score the test rows, which follow those in the row numbers."""
    development, test = (partitioned.where(F.col(N.SPLIT) == s) for s in (N.DEVELOPMENT, N.TEST))
    pre = fit_preprocessor(development, groups)
    # The fit reads its rows several times; they are encoded once.
    train = store_encoded(pre, development, groups, [*N.KEYS, target])
    carried = [*N.KEYS, *(c for c in (N.ROW_NUMBER, N.SPLIT, N.ORDER_VALUE) if c in test.columns)]
    held_out = store_encoded(pre, test, groups, carried)
    if target == N.LATE:
        return score_late(fit_gbt_classifier(train, candidate), held_out, candidate.candidate_id, threshold, before=train.count())
    return score_profit(fit_gbt_regressor(train, candidate), held_out, candidate.candidate_id, before=train.count())


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = N.KEYS) -> DataFrame:
    """A repeatable sample of ``n`` rows: the same keys are drawn whatever the partitioning or engine."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.orderBy(drawn, *keys).limit(n)
