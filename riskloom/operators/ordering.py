"""Global order without a single-task sort.

``row_number`` over an unpartitioned window sends the whole table to one task, and
Spark's exact ``percentile`` keeps every distinct value of a group in one buffer.
Quantiles and single rows are selected by counting (``exact_quantiles``, ``row_at``).  Row numbers and
running sums, which need the place of every row, use one range-partitioned layout:

1. range-partition and sort by the full ordering key (unique or pre-aggregated, so
   no hot value can pile up in one slice);
2. write that layout to the shared folder together with each row's position, so
   the slice borders are frozen and survive executor loss;
3. turn positions inside slices into global ones with a table of slice totals,
   which has one row per slice and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_SLICE, _OFFSET = "_slice", "_offset"
#: Rows that a slice of a global order has at most, about.
ROWS_PER_SLICE = 4_000_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of grouped results in which NULL is a group like any other."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


_OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def ordered_layout(df: DataFrame, order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """``df`` laid out in global order, with ``_slice`` and ``_offset`` columns.

    Unless ``slices`` says how many, there are at least the session's shuffle partitions, and more where a slice
    would have over ``ROWS_PER_SLICE`` rows; the number of rows comes from a store of the input, so it is computed once.
    """
    if slices is None:
        df = materialize(df, "unordered")
        slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_SLICE))
    placed = (
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id())
    )
    stored = materialize(placed, "ordered")
    position = F.col("_position")
    return stored.select(
        *df.columns,
        F.shiftright(position, _OFFSET_BITS).alias(_SLICE),
        position.bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)).alias(_OFFSET),
    )


def chronological_row_number(
    df: DataFrame, order: Sequence[str], name: str, slices: int | None = None
) -> DataFrame:
    """1-based row number of the whole table in the given order, without gaps."""
    laid = ordered_layout(df, order, slices)
    # One row per slice.
    starts = laid.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("_n")).select(
        _SLICE,
        F.coalesce(
            F.sum("_n").over(Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return laid.join(F.broadcast(starts), _SLICE).select(
        *df.columns, (F.col("_before") + F.col(_OFFSET) + 1).alias(name)
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Inclusive running sums of ``values`` along ``order`` inside each group.

    ``df`` must already be aggregated to one row per group and order key.  Each
    value ``v`` gains ``v_upto``.  Window partitions are slices, never whole groups.
    """
    laid = ordered_layout(df, [*[F.col(g) for g in group], *order])
    keys = [*group, _SLICE]
    starts = laid.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *keys, *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    inside = Window.partitionBy(*keys).orderBy(_OFFSET).rowsBetween(Window.unboundedPreceding, 0)
    summed = laid.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values])
    joined = join_null_safe(summed, starts, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_i_{v}") + F.col(f"_b_{v}")).alias(f"{v}_upto") for v in values]
    )


#: Buckets per e-fold of a value, and parts that a bucket is cut into next.
_PER_FOLD, _PARTS = 200, 4096


def _bucket(v: Column) -> Column:
    """Number of a value's bucket on a logarithmic scale of both signs; never falls as values rise.  NaN is last."""
    scaled = F.signum(v) * F.floor(F.log1p(F.abs(v) * 1e6) * _PER_FOLD)
    far = F.lit(1 << 40)
    return F.when(F.isnan(v), 2 * far).when(v == float("inf"), far).when(v == float("-inf"), -far).otherwise(scaled).cast("long")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Which part of its bucket's span a value lies in; never falls as values rise."""
    wide = (high > low) & ~F.isnan(high) & (F.abs(high - low) < float("inf"))
    return F.when(wide, F.floor((v - low) / (high - low) * _PARTS)).otherwise(0).cast("long")


def _holders(
    spans: DataFrame, groups: Sequence[str], along: str, wanted: DataFrame | None, probabilities: Sequence[float], discrete: bool = False
) -> DataFrame:
    """The spans that hold wanted positions, with each position ``_k`` counted from the span's first row.

    ``spans`` has a row count ``_m`` for each group and ``along``.  Without ``wanted`` the positions are
    those of the probabilities in the whole group; ``discrete`` ones are whole, ``ceil(p * n)`` counted from 1.
    """
    before = Window.partitionBy(*groups).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    if wanted is None:
        placed = placed.withColumn("_total", F.sum("_m").over(Window.partitionBy(*groups)))
        placed = placed.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        # In decimals, so that 0.67 of 300 is 201 and not a little more.
        nth = F.ceil(F.col("_p").cast("decimal(12,10)") * F.col("_total").cast("decimal(19,0)"))
        place = F.greatest(nth.cast("long"), F.lit(1).cast("long")) - 1 if discrete else F.col("_p") * (F.col("_total") - 1)
        placed = placed.withColumn("_h", place.cast("double"))
        # Each probability needs the values at one or two integer positions.
        both = F.array_distinct(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long")))
        placed = placed.withColumn("_k", F.explode(both)).drop("_total")
    else:
        placed = join_null_safe(placed, wanted, groups)
    inside = (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_m"))
    return placed.where(inside).withColumn("_k", F.col("_k") - F.col("_from")).drop("_from", "_m")


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    weight: str | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``group, probability, quantile``; ``discrete`` ones are values of the column.

    NULL values are ignored; NULL group keys form a group.  ``weight`` names a
    repetition count when the input is already aggregated.

    Values are selected, not sorted: rows are counted by bucket of their value, the buckets
    that hold the wanted positions are cut finer and counted again, and only what lies in one of those parts is
    put in order.  Counts are aggregated before every shuffle, so the rows themselves never move, but for the few in
    the last parts; a hot value is one row there.
    """
    gs = [f"_g{i}" for i in range(len(group))]
    stored = materialize(df.where(F.col(value).isNotNull()).select(
        *[F.col(g).alias(a) for g, a in zip(group, gs)], F.col(value).cast("double").alias("_v"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n"), _bucket(F.col(value).cast("double")).alias("_b")), "values")
    coarse = stored.groupBy(*gs, "_b").agg(F.sum("_n").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # A row for each group, probability and neighbour: their real size decides how they are joined.
    first = materialize(_holders(coarse, gs, "_b", None, probabilities, discrete), "buckets")

    at = [*gs, "_b"]
    opened = join_null_safe(stored, first.select(*at, "_low", "_high").distinct(), at)
    opened = opened.withColumn("_c", _part(F.col("_v"), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    fine = opened.groupBy(*at, "_c").agg(F.sum("_n").alias("_m"))
    second = materialize(_holders(fine, at, "_c", first.drop("_low", "_high"), probabilities), "parts")

    at = [*at, "_c"]
    values = join_null_safe(opened, second.select(*at).distinct(), at).groupBy(*at, "_v").agg(F.sum("_n").alias("_m"))
    found = _holders(values, at, "_v", second, probabilities)
    low = F.min("_v")
    step = F.max("_v") - F.min("_v")
    # Equal neighbours leave no step, even where it cannot be taken, as between infinities.
    interpolated = F.when(F.min("_v") == F.max("_v"), low).otherwise(low + step * (F.max("_h") - F.floor(F.max("_h"))))
    result = found.groupBy(*gs, "_p").agg(interpolated.alias("quantile"))
    return result.select(
        *[F.col(a).alias(g) for a, g in zip(gs, group)], F.col("_p").alias("probability"), "quantile"
    )


def row_at(df: DataFrame, order: Sequence[str], position: int) -> dict | None:
    """The ordering keys of the row at ``position`` (from 1) in ascending order, nulls first; None beyond the last.

    Rows are counted by the first key, a number or a time, as for quantiles; only those that share its value there
    are put in order by the other keys.
    """
    first = F.col(order[0])
    kind = df.schema[order[0]].dataType.typeName()
    if kind.startswith("timestamp"):
        number = F.unix_micros(first) if kind == "timestamp" else F.unix_micros(first.cast("timestamp"))
    elif kind == "date":
        number = F.unix_date(first)
    elif kind in ("byte", "short", "integer", "long", "float", "double"):
        number = first
    else:
        raise ValueError(f"{order[0]} is neither a number nor a time")
    counts = materialize(df.groupBy(number.alias("_key"), _bucket(number.cast("double")).alias("_b")).agg(F.count(F.lit(1)).alias("_n")), "keys")
    nulls = counts.where(F.col("_key").isNull()).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if position <= nulls:
        here, before = first.isNull(), 0
    else:
        known = counts.where(F.col("_key").isNotNull())
        spans = known.groupBy("_b").agg(F.sum("_n").alias("_m")).withColumn("_k", F.lit(position - 1 - nulls).cast("long"))
        held = _span_at(spans, "_b").first()
        if held is None:
            return None
        values = known.where(F.col("_b") == held["_b"]).select("_key", F.col("_n").alias("_m")).withColumn("_k", F.lit(held["_k"]))
        value = _span_at(values, "_key").first()
        here, before = number == value["_key"], position - 1 - value["_k"]
    rest = list(order[1:])
    bracket = df.where(here).select(*order)
    if not rest:
        return bracket.first().asDict()
    place = position - before
    numbered = chronological_row_number(bracket, rest, "_place").where(F.col("_place") == place)
    row = numbered.select(*order).first()
    return row.asDict() if row else None


def _span_at(spans: DataFrame, along: str) -> DataFrame:
    """The one of all spans that holds ``_k``, with ``_k`` counted from its first row; a bucket, or the keys of one."""
    before = Window.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    inside = (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_m"))
    return placed.where(inside).withColumn("_k", F.col("_k") - F.col("_from"))


def quantile_columns(
    df: DataFrame, group: Sequence[str], value: str, named: dict[str, float], weight: str | None = None
) -> DataFrame:
    """``exact_quantiles`` with one column per named probability, one row per group."""
    long = exact_quantiles(df, group, value, sorted(set(named.values())), weight)
    return long.groupBy(*group).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for n, p in named.items()]
    )
