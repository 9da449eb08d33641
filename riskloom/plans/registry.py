"""Named queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with its reference SQL if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """Round floating aggregates that depend on summation order."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def doubles(df: DataFrame) -> DataFrame:
    """DECIMAL columns as doubles, the type results are compared in."""
    cast = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if f.dataType.typeName() == "decimal"}
    return df.withColumns(cast) if cast else df


def load() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_cleaning, q_decisions, q_evaluation, q_features, q_measures, q_model_checks, q_models, q_profiles, q_serving, q_tables,
    )
