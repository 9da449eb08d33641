"""Feature-availability catalog: validation and registration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import problem_report

# FIXED VALUES: catalog columns and controlled vocabularies.
CATALOG_COLUMNS = [
    "source_column",
    "silver_column",
    "semantic_group",
    "availability_timing",
    "ao1_policy",
    "ao2_policy",
    "dashboard_policy",
    "modeling_use",
    "rationale",
    "derived_feature_guidance",
    "related_document",
]
CATALOG_VOCABULARY = {
    "availability_timing": [
        "order_creation",
        "before_dispatch",
        "after_shipment",
        "after_delivery",
        "after_order_review",
        "target_or_outcome",
        "sensitive_identifier",
        "descriptive_only",
    ],
    "ao1_policy": ["allowed", "review", "forbidden", "target"],
    "ao2_policy": ["allowed", "review", "forbidden", "target"],
    "dashboard_policy": ["allowed", "review", "forbidden"],
    "modeling_use": [
        "direct_candidate",
        "derived_only",
        "training_only_aggregate",
        "join_key_only",
        "review",
        "dashboard_only",
        "exclude",
    ],
}


def vocabulary_violations(df: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """``column_name, invalid_value, row_count`` for every value outside its vocabulary."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("invalid_value"),
                F.coalesce(F.col(c).isin(*allowed), F.lit(False)).alias("ok"),
            )
            for c, allowed in vocabulary.items()
        ]
    )
    bad = F.filter(pairs, lambda p: ~p["ok"])
    return (
        df.select(F.explode(bad).alias("p"))
        .groupBy("p.column_name", "p.invalid_value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def catalog_problems(
    df: DataFrame,
    unique: Sequence[str] = ("source_column", "silver_column"),
    vocabulary: Mapping[str, Sequence[str]] = CATALOG_VOCABULARY,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All problems of a catalog as ``problem, subject, row_count``; empty when it is sound."""
    columns = list(columns or df.columns)
    blank = df.select(
        F.explode(
            F.filter(
                F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]),
                lambda cell: F.coalesce(cell["v"], F.lit("")) == "",
            )
        ).alias("cell")
    )
    found = blank.groupBy(F.col("cell.c").alias("subject")).agg(F.count(F.lit(1)).alias("row_count"))
    found = found.select(F.lit("blank_cell").alias("problem"), "subject", "row_count")
    for c in unique:
        repeated = df.groupBy(F.col(c).cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("row_count"))
        found = found.unionByName(
            repeated.where("row_count > 1").select(F.lit(f"duplicate_{c}").alias("problem"), "subject", "row_count")
        )
    invalid = vocabulary_violations(df, vocabulary).select(
        F.concat(F.lit("vocabulary_"), F.col("column_name")).alias("problem"),
        F.col("invalid_value").alias("subject"), "row_count",
    )
    return found.unionByName(invalid)


def register_feature_catalog(df: DataFrame) -> DataFrame:
    """Validated catalog with its registration time."""
    if list(df.columns) != CATALOG_COLUMNS:
        raise ValueError(f"catalog columns must be exactly {CATALOG_COLUMNS}")
    if report := problem_report(catalog_problems(df), "row_count"):
        raise ValueError(f"catalog is not sound: {report}")
    return df.withColumn("_registered_timestamp", F.current_timestamp())


# FIXED VALUES: target fields with the policy column that marks them, and proxies that stay out of models.
TARGET_FIELDS = {"Late_delivery_risk": "ao1_policy", "Order Profit Per Order": "ao2_policy"}
FORBIDDEN_PROXIES = [
    "Delivery Status",
    "Days for shipping (real)",
    "Benefit per order",
    "Order Item Profit Ratio",
    "shipping date (DateOrders)",
    "Order Status",
]


def _problem(rows: DataFrame, problem: str, subject: str) -> DataFrame:
    return rows.select(F.lit(problem).alias("problem"), F.col(subject).cast("string").alias("subject"))


#: Rows that are written out from one row of a count at a time.
STRETCH = 65_536


def _repeated(counted: DataFrame, value: str, times: str) -> DataFrame:
    """``value`` of each row as often as ``times`` says; stretches of the repeats are dealt to all tasks first."""
    spark = counted.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    last = F.floor((F.col(times) - 1) / STRETCH).cast("long")
    stretches = counted.select(value, times, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_stretch"))
    here = F.least(F.col(times) - F.col("_stretch") * STRETCH, F.lit(STRETCH)).cast("int")
    return stretches.repartition(slices, value, "_stretch").select(F.explode(F.array_repeat(F.col(value), here)).alias(value))


def dictionary_problems(dictionary: DataFrame, columns: DataFrame, screened: DataFrame, lineage: Sequence[str] = ()) -> DataFrame:
    """``problem, subject`` where a schema dictionary disagrees with the schema and the screening.

    ``dictionary``: column_name, data_type, source_layer, source_name, guidance, review_status;
    ``columns``: the column_name and data_type that the table really has; ``screened``: the
    screened raw fields as variable_name.  Columns of ``lineage`` need no guidance.
    """
    listed = dictionary.groupBy("column_name", "data_type").agg(F.count(F.lit(1)).alias("_n"))
    real = columns.groupBy(F.col("column_name").alias("c"), F.col("data_type").alias("t")).agg(F.count(F.lit(1)).alias("_m"))
    # A name that is often on both sides meets as counts, and only what is told of its pairs is written out.
    wrong = listed.join(real, F.col("column_name") == F.col("c")).where("NOT data_type <=> t")
    wrong = _repeated(wrong.groupBy("column_name").agg(F.sum(F.col("_n") * F.col("_m")).alias("_times")), "column_name", "_times")
    known = dictionary.select(F.col("column_name").alias("_known")).distinct()
    there = columns.select(F.col("column_name").alias("_there")).distinct()
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    raw = dictionary.where((F.col("source_layer") == "bronze") & (text("review_status") != "needs_review"))
    unscreened = raw.join(screened.select("variable_name").distinct(), F.col("source_name") == F.col("variable_name"), "left_anti")
    silent = (text("guidance") == "") & (text("review_status") == "") & ~F.col("column_name").isin(*lineage)
    return (
        _problem(columns.join(known, F.col("column_name") == F.col("_known"), "left_anti"), "undocumented_column", "column_name")
        .unionByName(_problem(dictionary.join(there, F.col("column_name") == F.col("_there"), "left_anti"), "unexpected_column", "column_name"))
        .unionByName(_problem(wrong, "type_mismatch", "column_name"))
        .unionByName(_problem(dictionary.where(silent), "no_guidance", "column_name"))
        .unionByName(_problem(unscreened, "not_screened", "column_name"))
    )


def screening_problems(
    screening: DataFrame, sources: DataFrame, engineered: DataFrame, targets: Mapping[str, str] = TARGET_FIELDS,
    proxies: Sequence[str] = FORBIDDEN_PROXIES, *, raw_origin: str,
) -> DataFrame:
    """``problem, subject`` of a leakage screening: coverage, target rows and forbidden proxies.

    ``screening``: variable_name, variable_origin (``raw_origin`` for source fields) and the
    policy columns; ``sources``: the source_column names that must be screened as raw; ``engineered``: variable_name and
    variable_origin of the features that must be.
    """
    raw = screening.where(F.col("variable_origin") == raw_origin)
    keys = ["variable_name", "variable_origin"]
    spark = screening.sparkSession
    wanted = spark.createDataFrame([*targets.items()], "name STRING, policy_column STRING")
    policy = F.lit(None).cast("string")
    for column in sorted(set(targets.values())):
        policy = F.when(F.col("policy_column") == column, F.col(column)).otherwise(policy)
    target = wanted.join(raw, F.col("name") == F.col("variable_name"), "left").withColumn("_policy", policy)
    target_ok = F.coalesce((F.col("_policy") == "target") & (F.col("modeling_policy") == "target_only"), F.lit(False))
    proxy = spark.createDataFrame([(p,) for p in proxies], "name STRING").join(raw, F.col("name") == F.col("variable_name"), "left")
    proxy_ok = F.lit(True)
    for column, value in (("ao1_policy", "forbidden"), ("ao2_policy", "forbidden"), ("dashboard_policy", "dashboard_only"), ("modeling_policy", "dashboard_only")):
        proxy_ok = proxy_ok & F.coalesce(F.col(column) == value, F.lit(False))
    missing = lambda df: df.where("variable_name IS NULL")
    return (
        _problem(sources.join(raw, F.col("source_column") == F.col("variable_name"), "left_anti"), "raw_field_not_screened", "source_column")
        .unionByName(_problem(engineered.join(screening, keys, "left_anti"), "feature_not_screened", "variable_name"))
        .unionByName(_problem(missing(target), "target_missing", "name"))
        .unionByName(_problem(target.where(~target_ok & F.col("variable_name").isNotNull()), "target_not_marked", "name"))
        .unionByName(_problem(missing(proxy), "proxy_missing", "name"))
        .unionByName(_problem(proxy.where(~proxy_ok & F.col("variable_name").isNotNull()), "proxy_allowed", "name"))
    )
