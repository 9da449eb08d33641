"""Process only the files that arrived since the last run.

Cleaning, feature and segment operators are row-local, so they apply to a stream as
they are.  The checkpoint remembers which files were taken, and the file sink commits
each batch once, so a lost executor or a restarted job neither drops nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_folder


def append_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    operator: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str | None = None,
    fmt: str = "parquet",
    source_options: dict[str, str] | None = None,
    source_format: str = "parquet",
) -> DataFrame:
    """Run ``operator`` over the new files of ``source`` and append its rows to ``target``."""
    stream = spark.readStream.format(source_format).schema(schema).options(**(source_options or {})).load(source)
    query = (
        operator(stream).writeStream.format(fmt).outputMode("append")
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/progress/{target.strip('/').replace('/', '_')}")
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
    return spark.read.format(fmt).load(target)
