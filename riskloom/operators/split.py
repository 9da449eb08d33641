"""Deterministic chronological partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions.aggregates import mean
from ..session import materialize
from .ordering import chronological_row_number, row_at


def split_label(number: Column, boundary: Column) -> Column:
    return F.when(number <= boundary, N.DEVELOPMENT).otherwise(N.TEST)


def chronological_split(
    df: DataFrame, ratio: float = N.DEVELOPMENT_RATIO, order: Sequence[str] = N.CHRONOLOGY
) -> DataFrame:
    """Row number and split label; the earliest ``floor(n * ratio)`` rows are development."""
    numbered = chronological_row_number(df, order, N.ROW_NUMBER)
    boundary = numbered.agg(F.floor(F.count(F.lit(1)) * ratio)).scalar()
    return numbered.withColumn(N.SPLIT, split_label(F.col(N.ROW_NUMBER), boundary))


def label_split(df: DataFrame, ratio: float = N.DEVELOPMENT_RATIO, order: Sequence[str] = N.CHRONOLOGY) -> DataFrame:
    """The split label alone: the boundary row is selected, and rows are compared with it instead of being numbered.

    The same labels as ``chronological_split`` gives, without a sort; order keys must be unique and not null.
    The rows are stored once, as they are read for the boundary and again for what is told of them.
    """
    df = materialize(df, "unlabelled")
    boundary = df.agg(F.floor(F.count(F.lit(1)) * ratio)).first()[0]
    return df.withColumn(N.SPLIT, F.when(_among_first(df, order, boundary), N.DEVELOPMENT).otherwise(N.TEST))


def _among_first(df: DataFrame, order: Sequence[str], position: int) -> Column:
    """Whether a row is one of the first ``position`` ones of the stored ``df``."""
    last = row_at(df, order, position) if position else None
    if last is None:
        return F.lit(False)
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])


def numbered_after(df: DataFrame, before: int, order: Sequence[str] = N.CHRONOLOGY) -> DataFrame:
    """Row numbers of the rows that follow the first ``before`` ones of a table: only they are put in order."""
    return chronological_row_number(df, order, N.ROW_NUMBER).withColumn(N.ROW_NUMBER, F.col(N.ROW_NUMBER) + before)


def slice_partition(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(N.SPLIT) == label)


def partition_usage(df: DataFrame) -> dict[str, object]:
    """Which partition may be fitted on, from the labels present.  The test rows never are."""
    labels = {r[0] for r in df.select(N.SPLIT).distinct().collect()}
    if labels == {N.TRAIN, N.VALIDATION, N.TEST}:
        return {"structure": "train_validation_test", "fit_on": N.TRAIN,
                "transform": [N.TRAIN, N.VALIDATION, N.TEST], "validation_available": True}
    if labels == {N.DEVELOPMENT, N.TEST}:
        return {"structure": "development_test", "fit_on": N.DEVELOPMENT,
                "transform": [N.DEVELOPMENT, N.TEST], "validation_available": False}
    raise ValueError(f"partition labels are unclear: {sorted(map(str, labels))}")


def inner_split(df: DataFrame, ratio: float = N.INNER_VALIDATION_RATIO, order: Sequence[str] = N.CHRONOLOGY) -> DataFrame:
    """Development rows with ``modeling_slice``: the first ``floor(n * (1 - ratio))`` train.

    Development rows are numbered 1 to n, so the boundary is a comparison with the
    number they already carry; of stored rows with the label alone, the boundary row is selected.
    """
    development = slice_partition(df, N.DEVELOPMENT)
    boundary = development.agg(F.floor(F.count(F.lit(1)) * (1.0 - ratio)))
    if N.ROW_NUMBER in df.columns:
        first = F.col(N.ROW_NUMBER) <= boundary.scalar()
    else:
        first = _among_first(development, order, boundary.first()[0])
    return development.withColumn("modeling_slice", F.when(first, N.INNER_TRAIN).otherwise(N.INNER_VALIDATION))


def partition_summary(df: DataFrame, target: str) -> DataFrame:
    """Overall and per-partition summary from one grouping-sets pass.

    Rows that carry only the label have their numbers told by the counts: development goes from 1 on without gaps.
    """
    t = F.col(target)
    if target == N.LATE:
        measures = [
            F.count_if(t == 1).alias("late_delivery_count"),
            F.count_if(t == 0).alias("non_late_count"),
        ]
    else:
        measures = [
            F.min(t).cast("double").alias(f"target_min_{target}"),
            F.max(t).cast("double").alias(f"target_max_{target}"),
            mean(t).alias(f"target_avg_{target}"),
        ]
    ts, number = N.ORDER_TS, N.ROW_NUMBER
    numbered = number in df.columns
    numbers = [F.min(number).alias(f"min_{number}"), F.max(number).alias(f"max_{number}")] if numbered else []
    out = df.rollup(N.SPLIT).agg(
        F.grouping(N.SPLIT).alias("_overall"),
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias(f"min_{ts}"), F.max(ts).alias(f"max_{ts}"),
        *measures,
        F.count_if(t.isNull()).alias("target_missing_count"),
        *numbers,
    )
    if not numbered:  # three rows at most from here on
        development = F.max(F.when(F.col(N.SPLIT) == N.DEVELOPMENT, F.col("row_count"))).over(Window.partitionBy(F.lit(1)))
        before = F.when(F.col(N.SPLIT) == N.TEST, F.coalesce(development, F.lit(0))).otherwise(0)
        out = out.withColumns({f"min_{number}": before + 1, f"max_{number}": before + F.col("row_count")})
    overall = F.col("_overall") == 1
    rows = df.agg(F.count(F.lit(1))).scalar()
    out = out.select(
        F.when(overall, "overall").otherwise("partition").alias("summary_level"),
        F.when(overall, "overall").otherwise(F.col(N.SPLIT)).alias(N.SPLIT),
        *[c for c in out.columns if c not in (N.SPLIT, "_overall")],
        (F.col("row_count") / rows).alias("percentage_of_total"),
    )
    if target == N.LATE:
        out = out.withColumn("late_delivery_rate", F.try_divide(F.col("late_delivery_count"), F.col("row_count")))
    return out


def class_distribution(df: DataFrame, target: str = N.LATE) -> DataFrame:
    """Class counts, positive rate and the negative-to-positive weight."""
    t = F.col(target)
    positive, negative = F.count_if(t == 1), F.count_if(t == 0)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), positive.alias("positive_count"), negative.alias("negative_count"),
        F.try_divide(positive, F.count(t)).alias("positive_rate"),
        F.coalesce(F.try_divide(negative, positive), F.lit(1.0)).alias("positive_class_weight"),
    )
