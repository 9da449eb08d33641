"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard scores every key by a hash of (shard, key), and the key goes to the shard with
the best score.  Scores of different shards do not depend on each other, so a new shard can
only win keys for itself, and a removed one only gives up its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bucket_count, bucket_of, col, free_names, prefix_sums, unit

#: Equal rows that are numbered as one, and how many such stretches of a row share a bucket.
STRETCH, STRETCHES_PER_BUCKET = 2048, 64


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that ``key`` belongs to.

    Shard i wins a share of the keys proportional to its positive weight: the smallest
    of -ln(u_i) / w_i is an exponential race.  A null key is a key of its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    stable = F.coalesce(key.cast("string"), F.lit("\0null"))
    race = [
        F.struct((-F.ln(unit(F.xxhash64(F.lit(f"shard {i}"), stable))) / float(w)).alias("time"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return (F.array_min(F.array(*race)) if len(race) > 1 else race[0])["shard"]


def assign_shards(
    rows: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard) and, if asked for, ``grown_shard``.

    Slots follow a hash of the whole row, so that they do not depend on partitioning.
    A shard is numbered in buckets of bounded size, never in one task.  Meant for
    narrow rows: they are stored once.  Equal rows are stored and numbered as one with its count, in stretches of at
    most ``STRETCH``, and come apart again at the end, so a table that holds one row very often has no large
    bucket either; their slots follow each other but for other rows between stretches.  A null text or other
    value is a value like any other (-0.0 is 0.0); an empty table gives an empty result.  ``shard`` and the other
    result names replace columns of these names.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    h, bucket, many, part, size, place = free_names(rows, "_h", "_bucket", "_many", "_part", "_part_size", "_place")
    hashed = rows.withColumn(h, F.xxhash64(*[col(c) for c in rows.columns]))
    counted = hashed.groupBy(*[col(c) for c in hashed.columns]).agg(F.count(F.lit(1)).alias(many))
    placed = counted.withColumn("shard", rendezvous(col(key), weights))
    if grown is not None:
        placed = placed.withColumn("grown_shard", rendezvous(col(key), grown))
    placed = materialize(placed, "shards")
    buckets = bucket_count(placed.count())
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / STRETCH))
    placed = placed.withColumn(part, F.explode(stretches))
    # The first stretches of a bucket's rows, then the further ones of its frequent rows, some at a time.
    further = F.floor((F.col(part) + STRETCHES_PER_BUCKET - 1) / STRETCHES_PER_BUCKET)
    placed = placed.withColumns({
        bucket: F.shiftleft(bucket_of(F.col(h), buckets).cast("long"), 36) + further,
        size: F.least(F.lit(STRETCH).cast("long"), F.col(many) - F.col(part) * STRETCH),
    })
    order = [F.col(h), *[col(c) for c in rows.columns], F.col(part)]
    summed = prefix_sums(placed, ["shard"], bucket, order, size, "slot")
    spread = summed.withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1)))
    shards = ["shard"] if grown is None else ["shard", "grown_shard"]
    return spread.select(*[col(c) for c in rows.columns], *shards, (F.col("slot") + F.col(place)).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, each file sorted by slot; a hot shard is written by many tasks."""
    buckets = bucket_count(sharded.count())
    (sharded.repartition("shard", F.floor(F.col("slot") / 16384) % buckets)
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
