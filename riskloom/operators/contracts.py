"""Data contracts and checks.

Every check over rows is one aggregation, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N


def unpivot_row(one_row: DataFrame, name: str, value: str) -> DataFrame:
    """Columns of a one-row result as ``name, value`` rows."""
    return one_row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in one_row.columns]))
    )


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows violating each named rule: ``rule, violations``."""
    return unpivot_row(df.agg(*[F.count_if(bad).alias(n) for n, bad in rules.items()]), "rule", "violations")


def domain_rules(domains: Mapping[str, Sequence]) -> dict[str, Column]:
    """Rules for values outside a closed set.  NULL does not violate a domain."""
    return {f"domain_{c}": ~F.col(c).isin(*allowed) for c, allowed in domains.items()}


def range_rules(ranges: Mapping[str, tuple[float, float]]) -> dict[str, Column]:
    return {f"range_{c}": ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()}


def binary_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Rules for flags, where NULL is a violation as well."""
    return {f"binary_{c}": ~F.coalesce(F.col(c).isin(0, 1), F.lit(False)) for c in columns}


# FIXED VALUES: allowed ranges of the order-time features.
TIME_RANGES = {
    "order_quarter": (1, 4), "order_month": (1, 12), "order_week_of_year": (1, 53),
    "order_day_of_month": (1, 31), "order_day_of_week": (1, 7), "order_hour": (0, 23),
    "order_is_weekend": (0, 1),
}


def order_time_rules() -> dict[str, Column]:
    return range_rules(TIME_RANGES) | domain_rules({"order_season": N.SEASONS})


def shipping_product_rules() -> dict[str, Column]:
    non_negative = [
        "scheduled_shipping_days",
        "product_list_price",
        "item_unit_price",
        "item_discount_amount",
        "item_gross_sales_estimate",
        "item_net_sales_amount",
    ]
    return {
        **{f"non_negative_{c}": F.col(c) < 0 for c in non_negative},
        **domain_rules({"shipping_speed_tier": N.SPEED_TIERS}),
        **range_rules({"item_discount_rate": (0, 1), "item_discount_share_of_gross": (0, 1)}),
        **binary_rules(["is_same_day_or_next_day_shipping", "is_standard_shipping", "product_status_flag"]),
        "positive_order_item_quantity": F.col("order_item_quantity") <= 0,
    }


def customer_regional_rules() -> dict[str, Column]:
    flags = [c for c in N.CUSTOMER_REGIONAL_FEATURES if c.endswith(("_available", "_match"))]
    return binary_rules(flags) | range_rules({"latitude_rounded": (-90, 90), "longitude_rounded": (-180, 180)})


def segment_summary_rules() -> dict[str, Column]:
    """Rules of the geographic segment summary."""
    dims = (N.SEGMENT, N.HIGH_RISK, "ao2_expected_profit_band", "order_date_key")
    return {
        **{f"null_{c}": F.col(c).isNull() for c in dims},
        **range_rules({"map_latitude": (-90, 90), "map_longitude": (-180, 180),
                       "high_risk_order_rate": (0, 1), "high_margin_order_rate": (0, 1)}),
        **{f"non_negative_{c}": F.col(c) < 0 for c in
           ("order_count", "order_item_count", "high_risk_order_count", "high_margin_order_count")},
        **domain_rules({"ao2_expected_profit_band": N.PROFIT_BANDS_DASH}),
    }


def kpi_detail_rules() -> dict[str, Column]:
    """Rules of the order KPI detail, with its two additive invariants."""
    flags = [
        "valid_delivery_metric_flag",
        "actual_on_time_delivery_flag",
        "actual_late_delivery_flag",
        "ao1_high_risk_flag",
        "true_positive_flag",
        "false_positive_flag",
        "false_negative_flag",
        "true_negative_flag",
        "intervention_required_flag",
    ]
    required = [N.ORDER, N.ITEM, "order_month_key", "shipping_mode_normalized", "risk_band",
                "ao3_action_queue_label", N.RISK, N.HIGH_RISK, N.EXPECTED_PROFIT, N.MARGIN, N.ORDER_VALUE, N.SEGMENT]
    c = F.col
    confusion = sum((c(x) for x in flags[5:8]), c(flags[4]))
    return {
        **{f"null_{x}": c(x).isNull() for x in required},
        **range_rules({N.RISK: (0, 1), "ao1_expected_on_time_probability": (0, 1)}),
        **binary_rules(flags),
        "outcome_flags_sum": c(flags[1]) + c(flags[2]) != c(flags[0]),
        "confusion_flags_sum": confusion != c(flags[0]),
    }


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot_row(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), "column_name", "null_count")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-NULL values per column.

    Distinct (column, value) pairs first, so no task ever holds all values of a column.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
        ).alias("p")
    ).select("p.*")
    return pairs.distinct().groupBy("column_name").agg(F.count("v").alias("distinct_values"))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def uniqueness(df: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    """Rows, distinct keys and keys that occur more than once."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
    )


def assert_unique(df: DataFrame, keys: Sequence[str] = N.KEYS) -> DataFrame:
    found = uniqueness(df, keys).first()
    if found["duplicated_keys"]:
        raise ValueError(f"{found['duplicated_keys']} keys repeat over {list(keys)}")
    return df


def assert_no_forbidden(df: DataFrame, forbidden: Sequence[str] = N.SERVED_FORBIDDEN) -> DataFrame:
    leaked = sorted(set(forbidden) & set(df.columns))
    if leaked:
        raise ValueError(f"forbidden columns present: {leaked}")
    return df


@dataclass(frozen=True)
class Contract:
    """Expected shape of a table."""

    types: Mapping[str, str] = field(default_factory=dict)  # column -> Spark type name
    required: Sequence[str] = ()
    allowed: Sequence[str] | None = None  # None: no check for unexpected columns
    forbidden: Sequence[str] = ()
    non_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    rows: int | None = None
    rules: Mapping[str, Column] = field(default_factory=dict)


def schema_problems(df: DataFrame, contract: Contract) -> list[tuple[str, str, int]]:
    """Problems visible in the schema alone."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    needed = [*contract.required, *contract.types]
    problems = [("missing_column", c, 1) for c in dict.fromkeys(needed) if c not in have]
    problems += [("forbidden_column", c, 1) for c in contract.forbidden if c in have]
    if contract.allowed is not None:
        problems += [("unexpected_column", c, 1) for c in have if c not in contract.allowed]
    problems += [
        ("wrong_type", f"{c}: expected {t}, found {have[c]}", 1)
        for c, t in contract.types.items() if c in have and have[c] != t
    ]
    return problems


def check_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """All violations as ``problem, subject, violations``; empty for a sound table.

    Schema checks cost nothing; everything about rows is one aggregation, plus one
    keyed aggregation when a unique key is declared.
    """
    spark = df.sparkSession
    schema = "problem STRING, subject STRING, violations BIGINT"
    out = spark.createDataFrame(schema_problems(df, contract), schema)
    checks = {("null", c): F.count_if(F.col(c).isNull()) for c in contract.non_null if c in df.columns}
    checks |= {("rule", n): F.count_if(bad) for n, bad in contract.rules.items()}
    if contract.rows is not None:
        checks[("row_count", f"expected {contract.rows}")] = F.abs(F.count(F.lit(1)) - contract.rows)
    if checks:
        agg = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks.values())])
        rows = [
            F.struct(F.lit(p).alias("problem"), F.lit(s).alias("subject"), F.col(f"c{i}").alias("violations"))
            for i, (p, s) in enumerate(checks)
        ]
        out = out.unionByName(agg.select(F.inline(F.array(*rows))))
    if contract.unique:
        dup = uniqueness(df, contract.unique).select(
            F.lit("duplicate_key").alias("problem"), F.lit(", ".join(contract.unique)).alias("subject"),
            F.col("duplicated_keys").alias("violations"),
        )
        out = out.unionByName(dup)
    return out.where("violations > 0")


def problem_report(problems: DataFrame, count: str, examples: int = 20) -> str | None:
    """Numbers of all rows of ``problems``, in total and by ``problem``, and some as examples; None without any.

    ``count`` is the column that says how many rows of the checked table a problem has.
    """
    kinds = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("rows")).orderBy("problem").collect()
    if not kinds:
        return None
    by_kind = ", ".join(f"{k['problem']}: {k['n']} ({count} {k['rows']})" for k in kinds)
    some = [tuple(r) for r in problems.orderBy("problem", "subject").limit(examples).collect()]
    return f"{sum(k['n'] for k in kinds)} problems; {by_kind}; examples: {some}"


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` itself, or an error with the number of problems of each kind and examples of them."""
    if report := problem_report(check_contract(df, contract), "violations"):
        raise ValueError(f"contract violated: {report}")
    return df


def gold_contract(target: str, rows: int | None = None) -> Contract:
    """Contract of one of the two modelling tables."""
    late = target == N.LATE
    predictors = N.LATE_PREDICTORS if late else N.PROFIT_PREDICTORS
    doubles = {"item_unit_price", "item_discount_rate"}
    text = set(N.CATEGORICAL_FEATURES)
    types = {p: "string" if p in text else "double" if p in doubles else "int" for p in predictors}
    types[target] = "int" if late else "double"
    extra = [] if late else [N.ORDER_VALUE]
    rules = {"target_binary": ~F.col(target).isin(0, 1)} if late else {"order_value_positive": F.col(N.ORDER_VALUE) <= 0}
    return Contract(
        types=types | {e: "double" for e in extra},
        required=[*N.KEYS, target, *predictors, *extra],
        allowed=[*N.KEYS, target, *predictors, *extra, "_gold_ao1_processed_timestamp", "_gold_ao2_processed_timestamp"],
        forbidden=N.LATE_GOLD_FORBIDDEN if late else N.PROFIT_GOLD_FORBIDDEN,
        non_null=[*N.KEYS, target, *[p for p in predictors if p != "Type"], *extra],
        unique=N.KEYS, rows=rows, rules=rules,
    )


def silver_contract(rows: int | None = None) -> Contract:
    types = {c: "int" for c in N.SILVER_INTEGERS} | {c: "double" for c in N.SILVER_DOUBLES}
    types |= {c: "timestamp" for c in (*N.SILVER_TIMESTAMPS, N.INGEST_TS, N.SILVER_TS)}
    return Contract(types=types | {c: "string" for c in N.SILVER_TEXT}, rows=rows)


def bronze_contract(columns: Sequence[str], rows: int | None = None) -> Contract:
    """Source columns stay text and carry the two lineage columns."""
    types = {c: "string" for c in (*columns, N.SOURCE_FILE)}
    return Contract(types=types | {N.INGEST_TS: "timestamp"}, allowed=[*columns, N.INGEST_TS, N.SOURCE_FILE], rows=rows)


def row_number_complete(df: DataFrame, number: str = N.ROW_NUMBER) -> DataFrame:
    """Whether numbers run from 1 to n without gaps or repeats."""
    per = df.groupBy(number).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(
        F.min(number).alias("min_row_number"), F.max(number).alias("max_row_number"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_row_numbers"),
    )
    ok = (F.col("min_row_number") == 1) & (F.col("max_row_number") == F.col("row_count")) & (
        F.col("distinct_row_numbers") == F.col("row_count"))
    return out.withColumn("is_complete", ok)


def ordering_breaks(
    df: DataFrame, number: str = N.ROW_NUMBER, order: Sequence[str] = N.CHRONOLOGY, block: int = 1_000_000
) -> DataFrame:
    """Rows whose ordering key is smaller than that of the row numbered before.

    Compares inside blocks of consecutive numbers.  Each block also receives the
    first row of the next one, so that every adjacent pair is seen exactly once
    and no window spans the table.
    """
    key = F.struct(*order)
    own = F.floor((F.col(number) - 1) / block).cast("long")
    first_of_block = (F.col(number) - 1) % block == 0
    homes = F.when(first_of_block & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    spread = df.select(F.explode(homes).alias("_block"), F.col(number).alias(number), key.alias("_key"))
    previous = F.lag("_key").over(Window.partitionBy("_block").orderBy(number))
    return spread.withColumn("_previous", previous).where("_key < _previous").select(
        number, *[F.col(f"_key.{c}").alias(c) for c in order]
    )


def check_predictions(
    df: DataFrame,
    target: str,
    prediction: str,
    keys: Sequence[str] = ("model_name", *N.KEYS),
    slices: Sequence[str] = (N.INNER_VALIDATION,),
    tolerance: float = 1e-4,
) -> DataFrame:
    """Prediction-table rules for either objective: ``rule, violations``."""
    c = F.col
    rules = {f"null_{x}": c(x).isNull() for x in ("model_name", target, prediction)}
    if "evaluation_slice" in df.columns:
        rules["unexpected_slice"] = ~c("evaluation_slice").isin(*slices)
    for label in {"evaluation_slice", N.SPLIT} & set(df.columns):
        rules[f"held_out_rows_{label}"] = F.regexp_replace(F.lower(F.trim(c(label))), "[ -]", "_").rlike(
            "^(final_)?(test|hold_?out|held_?out)(_test)?$")
    if target == N.LATE:
        rules["non_binary_target"] = ~c(target).isin(0, 1)
        rules["probability_out_of_range"] = ~c(prediction).between(0, 1)
    else:
        error = c(target) - c(prediction)
        rules["residual_mismatch"] = F.abs(c("residual") - error) > tolerance
        rules["absolute_error_mismatch"] = F.abs(c("absolute_error") - F.abs(error)) > tolerance
    dup = uniqueness(df, keys).select(
        F.lit("duplicate_key").alias("rule"), F.col("duplicated_keys").alias("violations"))
    return rule_violations(df, rules).unionByName(dup)
