"""Modelling tables, enrichment joins and key reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..session import shared_folder
from .features import all_feature_columns


def primary_population(df: DataFrame) -> DataFrame:
    """Orders that really shipped.  Unknown status values drop the row, as in SQL."""
    return df.where(
        (F.col("Delivery_Status") != N.CANCELLED_DELIVERY)
        & ~F.col("Order_Status").isin(*N.EXCLUDED_ORDER_STATUS)
    )


def _gold_base(silver: DataFrame, target: str) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Population, predictor list and extra columns of one of the two modelling tables."""
    if target == N.LATE:
        return primary_population(silver), N.LATE_PREDICTORS, {}
    value = F.col("Order_Item_Total").cast("double")
    return silver, N.PROFIT_PREDICTORS, {N.ORDER_VALUE: value}


def gold_from_silver(silver: DataFrame, target: str, stamp: str | None = None) -> DataFrame:
    """Modelling table as one projection over silver.

    The feature sets are row-local, so joining them back on the row's own key would
    shuffle the table three times to find the row it started from.  Features that silver carries already,
    as they were made on a dimension's few rows, are taken as they are.
    """
    base, predictors, extra = _gold_base(silver, target)
    features = all_feature_columns(base.columns)
    return base.select(
        *N.KEYS, target,
        *[features.get(p, F.col(p)).alias(p) for p in predictors],
        *[e.alias(n) for n, e in extra.items()],
        *([F.current_timestamp().alias(stamp)] if stamp else []),
    )


def gold_from_tables(
    silver: DataFrame, feature_tables: Sequence[DataFrame], target: str, stamp: str | None = None
) -> DataFrame:
    """Modelling table from stored feature tables, inner-joined on the order-item key."""
    base, predictors, extra = _gold_base(silver, target)
    base = base.select(*N.KEYS, target, "Type", *[e.alias(n) for n, e in extra.items()])
    taken = {"Type"}
    parts = [base]
    for table in feature_tables:
        wanted = [p for p in predictors if p in table.columns and p not in taken]
        taken.update(wanted)
        parts.append(table.select(*N.KEYS, *wanted))
    missing = sorted(set(predictors) - taken)
    if missing:
        raise ValueError(f"predictors missing from the feature tables: {missing}")
    joined = reduce(lambda a, b: a.join(b, list(N.KEYS), "inner"), parts)
    return joined.select(
        *N.KEYS, target, *predictors, *extra, *([F.current_timestamp().alias(stamp)] if stamp else [])
    )


def store_by_keys(df: DataFrame, label: str, keys: Sequence[str] = N.KEYS, buckets: int | None = None) -> DataFrame:
    """``df`` as a stored table bucketed and sorted by ``keys``: joins and groupings by them need no shuffle of it.

    All tables that are to meet need the same number of buckets, by default the session's shuffle partitions; for
    large tables give one that keeps a bucket to some hundred megabytes.  The files lie in the shared folder, under a
    catalog name of this session.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    # Dealt by the bucketing's own hash, so that each bucket is one file.
    (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("compression", "zstd").option("path", f"{shared_folder(spark)}/bucketed-{name}").saveAsTable(name))
    return spark.table(name)


def dedupe_keys(df: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    return df.dropDuplicates(list(keys))


def enrich_left(facts: DataFrame, *dims: tuple[DataFrame, Sequence[str]], keys: Sequence[str] = N.KEYS) -> DataFrame:
    """Left-join each dimension's listed columns onto the facts."""
    return reduce(lambda f, d: f.join(d[0].select(*keys, *d[1]), list(keys), "left"), dims, facts)


def attach_dimension(fact: DataFrame, dim: DataFrame, key: str, keep_empty: bool = False) -> DataFrame:
    """Star look-up; ``keep_empty`` keeps dimension rows no fact refers to.

    The planner broadcasts the dimension when its size allows.
    """
    return fact.join(dim, key, "right" if keep_empty else "left")


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    """Keys of one side missing from the other, with the side they are on.

    Each side is counted by key once and the counts are joined, so neither input is computed twice, and
    tables bucketed by the keys are not shuffled.  A repeated key comes out as often as it is there; a key with a null in it is
    like no other.
    """
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, list(keys), "full").where(F.col("_l").isNull() | F.col("_r").isNull())
    side = F.when(F.col("_r").isNull(), F.lit("missing")).otherwise("unexpected")
    times = F.coalesce("_l", "_r").cast("int")
    return both.select(*keys, F.explode(F.array_repeat(side, times)).alias("side"))


def key_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    """Key overlap of two tables and their duplicates, from one aggregation.

    Tagged keys are counted per key, so a repeated key shows up without a second job.
    """
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both = (F.col("l") > 0) & (F.col("r") > 0)
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(both).alias("common_rows"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("left_only_rows"),
        F.count_if((F.col("r") > 0) & (F.col("l") == 0)).alias("right_only_rows"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("duplicated_keys"),
    )


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str] = N.KEYS, check: bool = True) -> DataFrame:
    """Inner join that insists on unique keys on both sides."""
    if check:
        coverage = key_coverage(left, right, keys).first()
        if coverage["duplicated_keys"]:
            raise ValueError(f"{coverage['duplicated_keys']} keys are not unique")
        if not coverage["common_rows"]:
            raise ValueError("the two sides share no key")
    return left.join(right, list(keys), "inner")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
