"""Bronze to silver: typed, trimmed, NULL on failure."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names as N
from ..functions.text import blank_to_null, collapse_whitespace


@dataclass(frozen=True)
class SilverSpec:
    """Which text columns become which types."""

    integers: Sequence[str] = field(default_factory=lambda: N.SILVER_INTEGERS)
    doubles: Sequence[str] = field(default_factory=lambda: N.SILVER_DOUBLES)
    timestamps: Sequence[str] = field(default_factory=lambda: N.SILVER_TIMESTAMPS)
    text: Sequence[str] = field(default_factory=lambda: N.SILVER_TEXT)
    watched_gaps: Sequence[str] = field(default_factory=lambda: N.SILVER_WATCHED_GAPS)
    pattern: str = N.RAW_TIMESTAMP_PATTERN


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nullify_blanks(df: DataFrame) -> DataFrame:
    return df.withColumns({c: blank_to_null(c) for c in _text_columns(df)})


def collapse_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: collapse_whitespace(c) for c in columns if c in df.columns})


def integer_or_null(text: Column) -> Column:
    """Text as an integer; decimals are cut off (``3.0`` and ``3.7`` give 3), anything else gives NULL."""
    whole = F.regexp_extract(text, r"^\s*([+-]?\d+)\.\d*\s*$", 1)
    return F.coalesce(text.try_cast("int"), whole.try_cast("int"))


def cast_columns(df: DataFrame, integers: Sequence[str] = (), doubles: Sequence[str] = ()) -> DataFrame:
    """Null-on-failure casts."""
    casts = {c: integer_or_null(F.col(c).cast("string")) for c in integers}
    return df.withColumns(casts | {c: F.col(c).try_cast("double") for c in doubles})


def parse_timestamps(df: DataFrame, columns: Sequence[str], pattern: str = N.RAW_TIMESTAMP_PATTERN) -> DataFrame:
    """Null-on-failure timestamp parse."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(pattern)) for c in columns})


def _clean_text(df: DataFrame, spec: SilverSpec) -> dict[str, Column]:
    """Trimmed, collapsed text of every text column, as expressions over the raw table."""
    out = {c: blank_to_null(c) for c in _text_columns(df)}
    return {c: collapse_whitespace(e) if c in spec.text else e for c, e in out.items()}


def _typed(clean: Mapping[str, Column], spec: SilverSpec) -> dict[str, Column]:
    typed = {c: integer_or_null(clean[c]) for c in spec.integers}
    typed |= {c: clean[c].try_cast("double") for c in spec.doubles}
    return typed | {c: F.try_to_timestamp(clean[c], F.lit(spec.pattern)) for c in spec.timestamps}


def clean_silver(df: DataFrame, spec: SilverSpec | None = None) -> DataFrame:
    """The whole cleaning step as a single projection over the bronze table."""
    spec = spec or SilverSpec()
    missing = sorted({*spec.integers, *spec.doubles, *spec.timestamps, *spec.text} - set(df.columns))
    if missing:
        raise ValueError(f"columns missing from bronze: {missing}")
    clean = _clean_text(df, spec)
    final = clean | _typed(clean, spec)
    return df.select(
        *[final.get(c, F.col(c)).alias(c) for c in df.columns],
        F.current_timestamp().alias(N.SILVER_TS),
    )


def _metrics(spec: SilverSpec, bronze: DataFrame) -> list[tuple[str, Column, str]]:
    """Name, aggregate over bronze rows and explanation of every metric that needs no silver table."""
    clean = _clean_text(bronze, spec)
    typed = _typed(clean, spec)
    final = clean | typed
    kinds = [("integer_cast", spec.integers, "cast to integer"), ("decimal_cast", spec.doubles, "cast to double"),
             ("timestamp_parse", spec.timestamps, "parsed as timestamps")]
    metrics = [("bronze_row_count", F.count(F.lit(1)), "Rows read from bronze.")]
    for c in spec.watched_gaps:
        metrics.append((f"missing_{c}", F.count_if(final[c].isNull()), "NULL values after cleaning."))
    for kind, columns, what in kinds:
        for c in columns:
            failed = clean[c].isNotNull() & typed[c].isNull()
            metrics.append((f"invalid_{kind}_{c}", F.count_if(failed), f"Non-NULL source values that could not be {what}."))
    return metrics


def _report(found: dict[str, int], metrics: list[tuple[str, Column, str]], written: int, silver: DataFrame, expected_rows: int | None) -> DataFrame:
    """The report's rows, one for each metric, from their values."""
    (first, _, about), *rest = metrics
    rows = [(first, found[first], about), ("silver_row_count", written, "Rows written to silver."),
            ("dropped_row_count", found[first] - written, "Rows dropped by cleaning.")]
    if expected_rows is not None:
        rows.append(("expected_bronze_rows", expected_rows, "Row count expected from the source."))
    rows += [(name, found[name], details) for name, _, details in rest]
    rows.append(("silver_column_count", len(silver.columns), ",".join(silver.columns)))
    table = silver.sparkSession.createDataFrame([(n, str(v), d) for n, v, d in rows], "metric_name STRING, metric_value STRING, metric_details STRING")
    return table.withColumn("_report_timestamp", F.current_timestamp())


def quality_report(
    bronze: DataFrame, silver: DataFrame, spec: SilverSpec | None = None, expected_rows: int | None = None
) -> DataFrame:
    """Row, gap, cast-failure and column metrics in one pass over bronze, for a silver table that is already stored.

    Gaps and failures are aggregates over the bronze row, as cleaning is row-local.  The
    rows and columns that were written are counted in the stored ``silver`` table.
    """
    metrics = _metrics(spec or SilverSpec(), bronze)
    found = bronze.agg(*[e.alias(name) for name, e, _ in metrics]).first().asDict()
    return _report(found, metrics, silver.count(), silver, expected_rows)


def write_silver(
    bronze: DataFrame, store: Callable[[DataFrame], DataFrame], spec: SilverSpec | None = None, keep: Column | None = None,
    expected_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean, store and measure in one pass: the stored silver table and its quality report.

    ``store`` writes a table and returns it as stored; ``keep`` leaves silver rows out.  All metrics are observed
    while the rows go by, so neither bronze nor silver is read again.  Scan, cleaning and write are one
    stage, whose rows are observed once, also if a task of it runs again.
    """
    spec = spec or SilverSpec()
    metrics = _metrics(spec, bronze)
    read, written = Observation(), Observation()
    silver = clean_silver(bronze.observe(read, *[e.alias(name) for name, e, _ in metrics]), spec)
    silver = silver if keep is None else silver.where(keep)
    stored = store(silver.observe(written, F.count(F.lit(1)).alias("n")))
    try:
        found, n = read.get, written.get["n"]
    except Py4JJavaError:  # where the optimizer knows that no row is left, it takes the observations away too
        return stored, quality_report(bronze, stored, spec, expected_rows)
    return stored, _report(found, metrics, n, stored, expected_rows)
