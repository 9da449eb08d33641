"""File and table input/output.

Writers stay distributed: no result is collected to be saved from the driver.
The storage format is a parameter (``parquet`` here; any installed table format works).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names as N


def read_raw_csv(
    spark: SparkSession,
    path: str,
    encoding: str = N.RAW_ENCODING,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV with every field kept as text.

    With ``columns`` given, the header is not consulted to build the schema, which
    saves the extra pass over the first file.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """Small reference CSV with inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def clean_name(name: str, keep_leading_underscore: bool = False) -> str:
    """Storage-safe column name."""
    out = re.sub("_+", "_", re.sub(r"[ ,;{}()\n\t=]", "_", name.strip()))
    return out if keep_leading_underscore and name.startswith("_") else out.strip("_")


def _clean_names(columns: Sequence[str], keep_leading_underscore: bool) -> list[str]:
    cleaned = [clean_name(c, keep_leading_underscore) for c in columns]
    clashes = sorted({c for c in cleaned if cleaned.count(c) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return cleaned


def sanitize_columns(df: DataFrame, keep_leading_underscore: bool = False) -> DataFrame:
    """Rename all columns to storage-safe names; a collision is an error."""
    return df.toDF(*_clean_names(df.columns, keep_leading_underscore))


def column_mapping(df: DataFrame, keep_leading_underscore: bool = False) -> DataFrame:
    """Position, source name, cleaned name and whether they differ."""
    cleaned = _clean_names(df.columns, keep_leading_underscore)
    rows = [(i, a, b, a != b) for i, (a, b) in enumerate(zip(df.columns, cleaned), 1)]
    schema = (
        "ordinal_position INT, source_column_name STRING, bronze_column_name STRING, was_renamed BOOLEAN"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def add_lineage(df: DataFrame, source_file: str | None = None) -> DataFrame:
    """Load time and source file; without a name, the file each row was read from."""
    return df.withColumns(
        {
            N.INGEST_TS: F.current_timestamp(),
            N.SOURCE_FILE: F.lit(source_file) if source_file else F.input_file_name(),
        }
    )


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


#: Formats that are plain folders of files; others bring transactions of their own.
FILE_FORMATS = ("parquet", "orc", "avro", "csv", "json", "text")


def file_system(spark: SparkSession, path: str):
    """Spark's own file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Replace the table (data and schema) and return it as stored.

    A folder of files is written beside the old one and then takes its place by renaming, so a
    write that fails leaves the old table, and a table may be replaced by something that reads it.
    """
    spark = df.sparkSession
    if mode != "overwrite" or fmt not in FILE_FORMATS:
        df.write.format(fmt).mode(mode).option("overwriteSchema", "true").save(path)
        return spark.read.format(fmt).load(path)
    path, mark = path.rstrip("/"), uuid.uuid4().hex
    staged, retired = f"{path}.{mark}-new", f"{path}.{mark}-old"
    fs, target = file_system(spark, path)
    _, new = file_system(spark, staged)
    _, old = file_system(spark, retired)
    try:
        df.write.format(fmt).save(staged)
    except BaseException:
        fs.delete(new, True)
        raise
    existed = fs.exists(target)
    if existed and not fs.rename(target, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(new, target):
        if existed:
            fs.rename(old, target)
        raise OSError(f"could not put the new table at {path}")
    if existed:
        fs.delete(old, True)
    return spark.read.format(fmt).load(path)


def ingest_bronze(
    spark: SparkSession, csv_path: str, table_path: str, source_file: str, fmt: str = "parquet"
) -> DataFrame:
    """Raw CSV to the all-text bronze table with lineage columns."""
    raw = sanitize_columns(read_raw_csv(spark, csv_path))
    return write_table(add_lineage(raw, source_file), table_path, fmt)


def export_csv(df: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Distributed CSV export with header.

    ``files`` bounds the number of part files for compact extracts; by default every
    task writes its own part, so that no single task handles the whole table.
    """
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).csv(path)
