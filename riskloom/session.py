"""Session helpers: local test sessions and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Tasks that single-file test tables are spread over; only local sessions set it.
SPREAD_CONF = "spark.riskloom.spread"
#: Folder of the running job, inside the shared one.
JOB_CONF = "spark.riskloom.job"
#: Bytes of bytecode up to which Spark fuses a stage into one method, and up to which the JVM compiles one.
METHOD_CONF, JVM_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", 8000


def local_session(cores: int | str = 8, app: str = "riskloom", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the local bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(SPREAD_CONF, str(cores if str(cores).isdigit() else 8))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local-mode session may fall back to a folder of its own: on a cluster
    a machine-local path would vanish with the executor that wrote it.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError(f"set {CHECKPOINT_CONF} to storage shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables that a job stores, deleted when the job is over.

    Everything stored inside the block goes there, so results must be written or
    collected before the block ends.
    """
    outer = shared_folder(spark)
    folder = f"{outer}/job-{uuid.uuid4().hex}"
    spark.conf.set(JOB_CONF, folder)
    try:
        yield folder
    finally:
        spark.conf.set(JOB_CONF, "")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compile_in_parts(spark: SparkSession) -> None:
    """Have wide projections compiled as many small methods, unless the session says how.

    Spark fuses a stage into one method, up to 64 KB of bytecode; the JVM leaves methods over 8,000 bytes
    interpreted.  Stages above that run operator by operator, whose expressions are compiled in parts.
    """
    if METHOD_CONF not in spark.conf.getAll:
        spark.conf.set(METHOD_CONF, JVM_METHOD_LIMIT)


def materialize(df: DataFrame, label: str = "stage", schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, by another ``schema`` of the same layout if one is given.

    Cuts lineage durably: the result survives executor loss, and anything
    non-deterministic above the cut (range bounds, row positions) is frozen.
    Parquet rather than an RDD checkpoint keeps column pruning and pushdown.
    """
    spark = df.sparkSession
    folder = spark.conf.get(JOB_CONF, "") or shared_folder(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
