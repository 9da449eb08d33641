"""Exploratory profiles.

Columns under study are unpivoted once and profiled together.  Values are counted
before anything else, so that repeated values cost one row each from then on.
Side tables have one row per studied column, which bounds every broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names as N
from ..functions.aggregates import ratio
from ..session import materialize
from .ordering import exact_quantiles, quantile_columns
from .sketches import PRECISION, distinct_estimate

VARIABLE = "variable_name"


def _long(df: DataFrame, columns: Sequence[str], value: str, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """``variable_name`` and ``value`` rows for the listed columns."""
    cells = [F.struct(F.lit(c).alias(VARIABLE), F.col(c).try_cast(kind).alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def _level(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("(missing)"))


def min_support(rows: Column) -> Column:
    """Rows a group needs before its rate is worth ranking."""
    return F.greatest(F.lit(N.MIN_SUPPORT_FLOOR), F.ceil(rows * N.MIN_SUPPORT_FRACTION))


# --- univariate --------------------------------------------------------------
# FIXED VALUES: patterns tried, in order, when text may hold timestamps.
TIMESTAMP_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy")


def _as_timestamp(value: Column) -> Column:
    """The time that a text holds.  Only text with a digit and a pattern's separator is tried: each failure raises in the JVM."""
    tried = [F.when(F.contains(value, F.lit("/" if "/" in p else "-")), F.try_to_timestamp(value, F.lit(p)).cast("timestamp_ntz"))
             for p in TIMESTAMP_PATTERNS]
    return F.when(value.rlike("[0-9]"), F.coalesce(value.try_cast("timestamp_ntz"), *tried))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Occurrences of each value (as text) of each column, NULL included."""
    return _long(df, columns, "value", "string").groupBy(VARIABLE, "value").agg(F.count(F.lit(1)).alias("n"))


def _declared(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"datetime": [], "numeric": [], "text": []}
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["datetime"].append(c)
        elif isinstance(t, T.NumericType):
            kinds["numeric"].append(c)
        else:
            kinds["text"].append(c)
    return kinds


def _classified(facts: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """``facts`` with the type class of each column."""
    looks_dated = (
        (F.col("_filled") >= 10) & (F.col("_stamps") >= 0.9 * F.col("_filled"))
        & (F.year("_first") >= 1900) & (F.year("_last") <= 2100)
    )
    return facts.withColumn(
        "status",
        F.when(F.col(VARIABLE).isin(*declared["datetime"]), "datetime")
        .when(F.col(VARIABLE).isin(*declared["numeric"]), "numeric")
        .when(looks_dated, "datetime")
        .when(F.col("_numbers") >= 0.8 * F.col("row_count"), "numeric")
        .otherwise("categorical"),
    )


def _reported(out: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """The profile's columns, from facts, quartiles and outlier counts."""
    missing = ratio(F.when(F.col("status") == "datetime", F.col("row_count") - F.greatest("_stamps", F.when(
        F.col(VARIABLE).isin(*declared["datetime"]), F.col("row_count") - F.col("_nulls")).otherwise(0)))
        .otherwise(F.col("_nulls")), F.col("row_count"))
    rate = ratio(F.col("outlier_count"), F.col("_known"))
    dated = F.col("status") == "datetime"
    return out.select(
        VARIABLE, "status", "row_count", missing.alias("missing_rate"), "unique_values",
        "summary_min", "summary_q1", "summary_median", "summary_q3", "summary_max",
        F.when(dated, F.col("_first")).alias("first_timestamp"), F.when(dated, F.col("_last")).alias("last_timestamp"),
        "outlier_count", rate.alias("outlier_rate"),
        F.coalesce(rate > 0.05, F.lit(False)).alias("high_outlier_rate"),
        ((F.col("status") == "categorical") & (F.col("unique_values") > 100)).alias("high_cardinality"),
        ((F.col("status") == "categorical") & (missing > 0.1)).alias("high_missingness"),
        (F.col("unique_values") == 1).alias("single_value"),
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type class, gaps, cardinality, quartiles, outliers and review flags per column.

    Text is a timestamp when 90% of at least ten non-blank values parse to years
    1900-2100, a number when 80% of all rows cast; every value is looked at.
    """
    columns = list(columns or df.columns)
    declared = _declared(df, columns)
    counts = materialize(value_counts(df, columns), "values")
    v, n = F.col("value"), F.col("n")
    number, ts = v.try_cast("double"), _as_timestamp(v)
    is_text, filled = F.col(VARIABLE).isin(*declared["text"]), F.trim(v) != ""

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    facts = counts.groupBy(VARIABLE).agg(
        F.sum(n).alias("row_count"), rows(v.isNull()).alias("_nulls"), F.count(v).alias("unique_values"),
        rows(filled).alias("_filled"), rows(number.isNotNull()).alias("_numbers"),
        rows(filled & ts.isNotNull() & is_text).alias("_stamps"),
        F.min(F.when(filled, ts)).alias("_first"), F.max(F.when(filled, ts)).alias("_last"),
    )
    facts = _classified(facts, declared)
    numbers = counts.select(VARIABLE, number.alias("x"), "n").where(
        F.col("x").isNotNull() & ~F.isnan("x")).join(
        F.broadcast(facts.where("status = 'numeric'").select(VARIABLE)), VARIABLE)
    q = quantile_columns(numbers, [VARIABLE], "x",
                         {"summary_min": 0.0, "summary_q1": 0.25, "summary_median": 0.5, "summary_q3": 0.75,
                          "summary_max": 1.0}, weight="n")
    outliers = numbers.join(F.broadcast(q), VARIABLE).groupBy(VARIABLE).agg(
        F.sum(F.when(_outside(F.col("x"), F.col("summary_q1"), F.col("summary_q3")), n).otherwise(0)).alias("outlier_count"),
        F.sum(n).alias("_known"))
    out = facts.join(q, VARIABLE, "left").join(outliers, VARIABLE, "left")
    return _reported(out, declared)


def sketched_profile(
    df: DataFrame, columns: Sequence[str] | None = None, precision: int = PRECISION, accuracy: int = 10_000
) -> DataFrame:
    """As ``profile``, from two aggregations over the rows in their own types: no value is shuffled.

    ``unique_values`` is a sketch's estimate (``sketches.bounds`` tells how far off it may be).
    Quartiles are values that occur, at most ``row_count / accuracy`` places off in rank, and outliers are
    counted by fences from them.  All other columns are exact.
    """
    columns = list(columns or df.columns)
    declared = _declared(df, columns)
    zero = F.lit(0).cast("long")

    def number(c: str) -> Column:
        x = F.col(c).try_cast("double") if c not in declared["datetime"] else F.lit(None).cast("double")
        return F.when(~F.isnan(x), x)

    # What is made of a value is made once; only text can be blank or has to be parsed.
    made: list[Column] = []
    for i, c in enumerate(columns):
        v = F.col(c)
        text = c in declared["text"]
        filled = F.trim(v.cast("string")) != "" if text else v.isNotNull()
        ts = v.cast("timestamp_ntz") if c in declared["datetime"] else F.lit(None).cast("timestamp_ntz")
        any_number = v.try_cast("double") if c not in declared["datetime"] else F.lit(None).cast("double")
        made += [v.alias(f"_v{i}"), filled.alias(f"_f{i}"), any_number.alias(f"_a{i}"),
                 F.when(filled, _as_timestamp(v.cast("string")) if text else ts).alias(f"_t{i}")]

    def facts_of(i: int, c: str) -> Column:
        v, filled, any_number, ts = (F.col(f"_{k}{i}") for k in "vfat")
        x = F.when(~F.isnan(any_number), any_number)
        return F.struct(
            F.lit(c).alias(VARIABLE), F.count(F.lit(1)).alias("row_count"), F.count_if(v.isNull()).alias("_nulls"),
            distinct_estimate(v, precision).alias("unique_values"), F.count_if(filled).alias("_filled"),
            F.count(any_number).alias("_numbers"),
            (F.count(ts) if c in declared["text"] else zero).alias("_stamps"),
            F.min(ts).alias("_first"), F.max(ts).alias("_last"),
            F.count(x).alias("_known"), F.percentile_approx(x, [0.0, 0.25, 0.5, 0.75, 1.0], accuracy).alias("_q"))

    facts = df.select(*made).agg(F.array(*[facts_of(i, c) for i, c in enumerate(columns)]).alias("all")).select(F.inline("all"))
    numeric = F.col("status") == "numeric"
    facts = materialize(_classified(facts, declared), "facts").withColumns({
        name: F.when(numeric, F.get("_q", F.lit(i)))
        for i, name in enumerate(("summary_min", "summary_q1", "summary_median", "summary_q3", "summary_max"))})
    # One row for each studied column.
    fences = facts.where(numeric & F.col("summary_q1").isNotNull()).select(VARIABLE, "summary_q1", "summary_q3").collect()
    counted = [F.struct(F.lit(r[0]).alias(VARIABLE), F.count_if(_outside(number(r[0]), F.lit(r[1]), F.lit(r[2]))).alias("outlier_count"))
               for r in fences]
    if counted:
        outliers = df.agg(F.array(*counted).alias("all")).select(F.inline("all"))
        facts = facts.join(F.broadcast(outliers), VARIABLE, "left")
    else:
        facts = facts.withColumn("outlier_count", F.lit(None).cast("long"))
    return _reported(facts, declared)


def _outside(x: Column, q1: Column, q3: Column) -> Column:
    reach = (q3 - q1) * 1.5
    return (x < q1 - reach) | (x > q3 + reach)


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, fences and outliers per numeric column."""
    long = materialize(_long(df, columns, "x", "double").where("x IS NOT NULL"), "studied")
    q = quantile_columns(long, [VARIABLE], "x", {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1"), "lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach})
    x = F.col("x")
    keys = [VARIABLE, "q1", "q3", "iqr", "lower_fence", "upper_fence"]
    out = long.join(F.broadcast(q), VARIABLE).groupBy(*keys).agg(
        F.count_if((x < F.col("lower_fence")) | (x > F.col("upper_fence"))).alias("outlier_count"),
        F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, "outlier_count", ratio(F.col("outlier_count"), F.col("_n")).alias("outlier_rate"))


def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.trunc(F.col(ts), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"))


# --- quantile bins -------------------------------------------------------------
def quantile_bins(df: DataFrame, group: Sequence[str], value: str, bins: int = 5) -> DataFrame:
    """Adds ``bin_number``, ``bin_lower`` and ``bin_upper``: right-closed quantile bins per group.

    The number of bins shrinks to the number of distinct values, and equal edges
    collapse.  ``group`` names a bounded set, such as the studied columns.
    """
    known = df.where(F.col(value).isNotNull())
    per_value = materialize(known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), "bins")
    steps = {(q, i): i / q for q in range(1, bins + 1) for i in range(q + 1)}
    q = exact_quantiles(per_value, group, value, sorted(set(steps.values())), weight="n")
    distinct = per_value.groupBy(*group).agg(F.count(F.lit(1)).alias("_d"))
    wide = q.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("probability", "quantile"))).alias("_q")).join(distinct, list(group))
    edges = F.lit(None)
    for k in range(1, bins + 1):
        chosen = F.array(*[F.col("_q")[F.lit(float(steps[k, i]))] for i in range(k + 1)])
        edges = F.when(F.least(F.col("_d"), F.lit(bins)) == k, F.array_distinct(chosen)).otherwise(edges)
    wide = wide.select(*group, edges.alias("_edges"))
    # Tests every inner edge; all values up to the second edge share the first bin.
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: F.col(value) > e)) + 1
    out = known.join(F.broadcast(wide), list(group)).withColumn("bin_number", place)
    return out.select(
        *df.columns, "bin_number", F.get(F.col("_edges"), F.col("bin_number") - 1).alias("bin_lower"),
        F.coalesce(F.get(F.col("_edges"), F.col("bin_number")), F.get(F.col("_edges"), F.lit(0))).alias("bin_upper"))


# --- against a binary target ------------------------------------------------------
def bivariate_rate(
    df: DataFrame, columns: Sequence[str], target: str = N.LATE, max_levels: int = N.MAX_DIRECT_LEVELS
) -> DataFrame:
    """Rate per level of each categorical column, against the overall rate.

    All levels of all columns have a row; ``high_cardinality`` marks columns with more
    than ``max_levels`` of them, which are better studied in groups.
    """
    counted, _ = _rates(df, columns, target)
    return counted.withColumn("high_cardinality", F.col("level_count") > max_levels)


def _rates(df: DataFrame, columns: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    valid = df.where(F.col(target).isin(0, 1))
    long = _long(valid, columns, "v", "string", keep=[target])
    y = F.col(target)
    counted = long.groupBy(VARIABLE, _level(F.col("v")).alias("level")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(y.cast("long")).alias("late_count"))
    stats = counted.groupBy(VARIABLE).agg(
        F.sum("row_count").alias("_rows"), F.sum("late_count").alias("_late"), F.count(F.lit(1)).alias("level_count"))
    rate = F.col("late_count") / F.col("row_count")
    out = counted.join(F.broadcast(stats), VARIABLE).select(
        VARIABLE, "level", "row_count", rate.alias("late_delivery_rate"),
        (rate - F.col("_late") / F.col("_rows")).alias("late_delivery_rate_difference"),
        (F.col("row_count") >= min_support(F.col("_rows"))).alias("supported"), "level_count")
    return out, stats


def bivariate_rate_summary(
    df: DataFrame, columns: Sequence[str], target: str = N.LATE, max_levels: int = N.MAX_DIRECT_LEVELS
) -> DataFrame:
    """Strongest, highest and lowest supported level of each column."""
    counted, _ = _rates(df, columns, target)
    ok = F.col("supported")
    level, rate, diff = F.col("level"), F.col("late_delivery_rate"), F.col("late_delivery_rate_difference")

    def best(key: Column) -> Column:
        return F.max_by(level, F.when(ok, F.struct(key.alias("k"), F.col("row_count").alias("n"), level.alias("l"))))

    return counted.groupBy(VARIABLE).agg(
        F.max("level_count").alias("level_count"),
        (F.max("level_count") > max_levels).alias("high_cardinality"),
        F.count_if(ok).alias("supported_levels"), F.count_if(~F.col("supported")).alias("unsupported_levels"),
        best(F.abs(diff)).alias("strongest_level"), best(rate).alias("highest_level"), best(-rate).alias("lowest_level"),
        F.max_by(diff, F.when(ok, F.struct(F.abs(diff).alias("k"), F.col("row_count").alias("n"), level.alias("l")))
                 ).alias("strongest_difference"),
    )


def bivariate_rate_numeric(df: DataFrame, columns: Sequence[str], target: str = N.LATE, bins: int = 5) -> DataFrame:
    """Rate per quantile bin of each numeric column, with whether it has enough rows."""
    valid = materialize(df.where(F.col(target).isin(0, 1)).select(target, *columns), "studied")
    rows = valid.agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col(target).cast("long")).alias("_late"))
    binned = quantile_bins(_long(valid, columns, "value", "double", keep=[target]), [VARIABLE], "value", bins)
    counted = binned.groupBy(VARIABLE, "bin_number", "bin_lower", "bin_upper").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col(target).cast("long")).alias("late_count"))
    overall = rows.select(F.col("_late") / F.col("_rows")).scalar()
    support = rows.select(min_support(F.col("_rows"))).scalar()
    rate = F.col("late_count") / F.col("row_count")
    return counted.select(
        VARIABLE, "bin_number", "bin_lower", "bin_upper", "row_count", (F.col("row_count") >= support).alias("supported"),
        rate.alias("late_delivery_rate"), (rate - overall).alias("late_delivery_rate_difference"))


def class_location(df: DataFrame, columns: Sequence[str], target: str = N.LATE) -> DataFrame:
    """Count, mean and median of each numeric column per target class."""
    valid = df.where(F.col(target).isin(0, 1))
    long = _long(valid, columns, "value", "double", keep=[target]).where("value IS NOT NULL")
    keys = [VARIABLE, target]
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.avg("value").alias("mean_value")).join(
        quantile_columns(long, keys, "value", {"median_value": 0.5}), keys)


# --- against a continuous target ---------------------------------------------------
def _overall(df: DataFrame, target: str) -> DataFrame:
    """One row: valid rows, mean and median of the target."""
    one = df.select(F.lit("all").alias("_part"), F.col(target).cast("double").alias("y")).where("y IS NOT NULL")
    return one.groupBy("_part").agg(F.count("y").alias("_rows"), F.avg("y").alias("_mean")).join(
        quantile_columns(one, ["_part"], "y", {"_median": 0.5}), "_part")


def _profit_groups(rows: DataFrame, keys: Sequence[str], df: DataFrame, target: str) -> DataFrame:
    """Count, mean and median of ``y`` per group and their distance from the overall figures."""
    whole = _overall(df, target).first()
    n = whole["_rows"] if whole else 0
    support = max(N.MIN_SUPPORT_FLOOR, -(-n * 5 // 1000))
    grouped = rows.groupBy(*keys).agg(F.count("y").alias("row_count"), F.avg("y").alias("mean_profit")).join(
        quantile_columns(rows, keys, "y", {"median_profit": 0.5}), list(keys))
    return grouped.withColumns(
        {
            "profit_difference_from_overall_mean": F.col("mean_profit") - F.lit(whole["_mean"] if whole else None),
            "profit_difference_from_overall_median": F.col("median_profit") - F.lit(whole["_median"] if whole else None),
            "sample_size_flag": F.when(F.col("row_count") >= support, "support_ok").otherwise("below_min_support"),
        }
    )


def bivariate_mean(
    df: DataFrame, columns: Sequence[str], target: str = N.PROFIT, max_levels: int = N.MAX_DIRECT_LEVELS
) -> DataFrame:
    """Mean and median of the target per level of each categorical column."""
    df = materialize(df.select(target, *[c for c in columns if c != target]), "studied")
    long = df.select(F.col(target).cast("double").alias("y"), *columns).where("y IS NOT NULL")
    long = _long(long, columns, "v", "string", keep=["y"]).select(
        VARIABLE, F.coalesce(F.trim("v"), F.lit("(missing)")).alias("level"), "y")
    sizes = long.select(VARIABLE, "level").distinct().groupBy(VARIABLE).agg(F.count(F.lit(1)).alias("_levels"))
    out = _profit_groups(long, [VARIABLE, "level"], df, target).join(sizes, VARIABLE)
    return out.withColumnRenamed("_levels", "level_count").withColumn("high_cardinality", F.col("level_count") > max_levels)


def bivariate_mean_numeric(df: DataFrame, columns: Sequence[str], target: str = N.PROFIT, bins: int = 5) -> DataFrame:
    """Mean and median of the target per quantile bin, with the pattern across supported bins."""
    df = materialize(df.select(target, *[c for c in columns if c != target]), "studied")
    known = df.select(F.col(target).cast("double").alias("y"), *columns).where("y IS NOT NULL")
    binned = materialize(
        quantile_bins(_long(known, columns, "value", "double", keep=["y"]), [VARIABLE], "value", bins), "binned")
    out = _profit_groups(binned, [VARIABLE, "bin_number", "bin_lower", "bin_upper"], df, target)
    return with_monotonic_pattern(out)


def with_monotonic_pattern(bins: DataFrame) -> DataFrame:
    """Whether mean profit rises or falls over the (few) ordered and supported bins of each column."""
    along = Window.partitionBy(VARIABLE).orderBy("bin_number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(VARIABLE)
    mean = F.when(F.col("sample_size_flag") == "support_ok", F.col("mean_profit"))
    stepped = bins.withColumn("_step", mean - F.last(mean, ignorenulls=True).over(along))
    up, down = F.min("_step").over(everything), F.max("_step").over(everything)
    label = (
        F.when(F.count(mean).over(everything) < 3, "too few bins for monotonicity comment")
        .when((up >= 0) & (down > 0), "mean profit increases across supported bins")
        .when((down <= 0) & (up < 0), "mean profit decreases across supported bins")
        .otherwise("nonlinear or uneven bin pattern")
    )
    return stepped.withColumn("monotonic_pattern", label).drop("_step")


def target_distribution(df: DataFrame, target: str = N.PROFIT) -> DataFrame:
    """Moments, percentiles, adjusted skewness and IQR outliers of a continuous target."""
    rows = materialize(df.select(F.lit("all").alias("part"), F.col(target).cast("double").alias("y")), "target")
    known = rows.where("y IS NOT NULL")
    probs = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    q = quantile_columns(known, ["part"], "y", probs)
    y, n = F.col("y"), F.count("y")
    correction = F.sqrt(n * (n - 1)) / (n - 2)  # population skewness to the sample-adjusted form
    moments = rows.groupBy("part").agg(
        n.alias("row_count"), F.count_if(y.isNull()).alias("missing_count"), F.avg(y).alias("mean_profit"),
        F.stddev_samp(y).alias("std_profit"), F.min(y).alias("min_profit"), F.max(y).alias("max_profit"),
        F.when(n > 2, F.skewness(y) * correction).alias("skewness"))
    outliers = known.join(F.broadcast(q), "part").groupBy("part").agg(
        F.count_if(_outside(y, F.col("p25"), F.col("p75"))).alias("outlier_count"))
    return moments.join(q, "part").join(outliers, "part").drop("part")


def proxy_audit(df: DataFrame, left: str, right: str, tolerance: float = 1e-9) -> DataFrame:
    """How nearly two columns are the same thing."""
    gap = F.abs(F.col(left).cast("double") - F.col(right).cast("double"))
    return df.agg(
        F.count(gap).alias("compared_rows"), ratio(F.count_if(gap <= tolerance), F.count(gap)).alias("exact_match_rate"),
        F.max(gap).alias("max_absolute_difference"))


# --- class balance -------------------------------------------------------------------
def imbalance_summary(df: DataFrame, target: str = N.LATE) -> DataFrame:
    """Class sizes, their ratio and how severe the imbalance is."""
    t = F.col(target)
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(t.isNull()).alias("missing_target_count"),
                 F.count_if(t == 1).alias("count_late_1"), F.count_if(t == 0).alias("count_not_late_0"))
    late, other = F.col("count_late_1"), F.col("count_not_late_0")
    valid = late + other
    balance = F.coalesce(ratio(F.greatest(late, other), F.least(late, other)), F.lit(float("inf")))
    return one.select(
        "*", valid.alias("rows_with_valid_binary_target"), ratio(late, valid).alias("late_delivery_rate"),
        ratio(other, valid).alias("not_late_rate"),
        F.when(late >= other, "late_1").otherwise("not_late_0").alias("majority_class"),
        F.when(late >= other, "not_late_0").otherwise("late_1").alias("minority_class"),
        balance.alias("majority_minority_class_ratio"),
        F.when(balance < 1.5, "mild").when(balance < 3.0, "moderate").otherwise("severe").alias("imbalance_severity"),
        min_support(valid).alias("minimum_slice_support"),
    )


def imbalance_slices(df: DataFrame, groups: Sequence[str], target: str = N.LATE) -> DataFrame:
    """Late rate of every group value of every approved grouping, in one pass."""
    valid = df.where(F.col(target).isin(0, 1))
    long = _long(valid, groups, "v", "string", keep=[target])
    counted = long.groupBy(
        F.col(VARIABLE).alias("grouping_variable"),
        F.coalesce(F.nullif(F.trim("v"), F.lit("")), F.when(F.col("v").isNull(), "(missing)").otherwise("(blank)")
                   ).alias("group_value"),
    ).agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(target).cast("long")).alias("late_count"))
    stats = counted.groupBy("grouping_variable").agg(F.sum("row_count").alias("_n"), F.sum("late_count").alias("_l"))
    rate = F.col("late_count") / F.col("row_count")
    support = min_support(F.col("_n"))
    return counted.join(F.broadcast(stats), "grouping_variable").select(
        "grouping_variable", "group_value", "row_count", "late_count",
        (F.col("row_count") - F.col("late_count")).alias("not_late_count"),
        rate.alias("late_delivery_rate"), (rate - F.col("_l") / F.col("_n")).alias("difference_from_overall_rate"),
        F.when(F.col("row_count") >= support, "meets_min_support")
        .otherwise(F.concat(F.lit("below_min_support_"), support.cast("string"), F.lit("_rows"))).alias("sample_size_flag"),
    )


# --- policy annotation -----------------------------------------------------------------
def _needs_review(policy: Column) -> Column:
    return ((policy == "conditional") | (F.col("screening_status") == "needs_group_review")
            | F.col("modeling_policy").contains("conditional"))


def _verdict(recommendation: str, review: bool, status: Column | str) -> Column:
    when = status if isinstance(status, Column) else F.lit(status)
    return F.struct(
        F.lit(recommendation).alias("recommendation"), F.lit(review).alias("requires_group_validation"),
        when.alias("decision_time_status"))


_GROUP_REVIEW = ("conditional_requires_group_review", True, "requires_group_review")


def annotate_late_policy(profiled: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recommendation and decision-time status of each profiled column for the late-delivery model."""
    policy, modeling = F.col("ao1_policy"), F.col("modeling_policy")
    review = _needs_review(policy)
    status = (
        F.when(policy == "target", _verdict("exclude_from_ao1_modeling", False, "target_only"))
        .when((policy == "forbidden") & (modeling == "dashboard_only"), _verdict("dashboard_only", False, "no"))
        .when(policy == "forbidden", _verdict("exclude_from_ao1_modeling", False, "no"))
        .when(policy == "not_applicable", _verdict("descriptive_context_only", False, "not_applicable"))
        .when(review, _verdict(*_GROUP_REVIEW))
        .when((policy == "allowed") & (modeling == "candidate_feature"), _verdict("candidate_for_gold_review", False, "yes"))
        .otherwise(_verdict("descriptive_context_only", False, F.col("decision_time_availability")))
    )
    return _annotated(profiled, catalog, status)


# FIXED VALUES: words that mark profit proxies and commercial fields.
PROFIT_PROXY_WORDS = ("profit", "benefit")
COMMERCIAL_WORDS = ("price", "discount", "sales", "total", "quantity")


def annotate_profit_policy(
    profiled: DataFrame, catalog: DataFrame,
    proxy_words: Sequence[str] = PROFIT_PROXY_WORDS, commercial_words: Sequence[str] = COMMERCIAL_WORDS,
) -> DataFrame:
    """The same for the profit model, where proxies and commercial fields need extra care."""
    policy, modeling, served = F.col("ao2_policy"), F.col("modeling_policy"), F.col("dashboard_policy")
    name = F.lower(F.col(VARIABLE))
    proxy, commercial = name.rlike("|".join(proxy_words)), name.rlike("|".join(commercial_words))
    shown = (served == "dashboard_only") | (modeling == "dashboard_only")
    status = (
        F.when((policy == "target") | proxy, _verdict("target_or_proxy_excluded", False, "target_or_proxy"))
        .when((policy == "forbidden") & shown, _verdict("dashboard_only", False, "no"))
        .when(policy == "forbidden", _verdict("exclude_from_ao2_modeling", False, "no"))
        .when(policy == "not_applicable", _verdict("descriptive_context_only", False, "not_applicable"))
        .when(commercial | _needs_review(policy), _verdict(*_GROUP_REVIEW))
        .when((policy == "allowed") & (modeling == "candidate_feature"), _verdict("candidate_for_gold_review", False, "yes"))
        .when(shown, _verdict("dashboard_only", False, "no"))
        .otherwise(_verdict("descriptive_context_only", False, F.col("decision_time_availability")))
    )
    return _annotated(profiled, catalog, status)


def _annotated(profiled: DataFrame, catalog: DataFrame, status: Column) -> DataFrame:
    return profiled.join(catalog, VARIABLE, "left").withColumn("_verdict", status).select(*profiled.columns, "_verdict.*")
