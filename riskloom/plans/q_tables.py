"""Readers, writers and publication, over tables written from the given data."""

import uuid

from pyspark.sql import functions as F

from .. import names as N
from ..session import shared_folder
from ..sources import files, publish
from . import oracle as O
from .orders import segments, table
from .registry import doubles, query


def _place(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("a1_a2_a4_raw_csv_scan", """
SELECT CAST(l_orderkey AS VARCHAR) AS Order_Id, CAST(l_linenumber AS VARCHAR) AS Order_Item_line, l_returnflag AS flag_raw,
  CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty, 'lines.csv' AS _source_file FROM lineitem""")
def a1(spark, sf):
    """Lines exported under untidy headers, scanned back as text and renamed."""
    path = _place(spark, "csv")
    untidy = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Order Id"), F.col("l_linenumber").alias("Order Item (line)"),
        F.col("l_returnflag").alias(" flag;;raw "), F.col("l_quantity").cast("int").alias("qty"))
    untidy.write.option("header", True).option("encoding", N.RAW_ENCODING).csv(path)
    raw = files.add_lineage(files.sanitize_columns(files.read_raw_csv(spark, path)), "lines.csv")
    return raw.drop(N.INGEST_TS)


@query("a5_table_round_trip", O.scored("""SELECT Order_Id, Order_Item_Id, order_date_DateOrders, segment AS ao3_priority_segment,
  margin_d AS ao3_predicted_margin FROM seg"""))
def a5(spark, sf):
    rows = segments(spark, sf).select(*N.KEYS, N.SEGMENT, N.MARGIN)
    return doubles(files.write_table(rows, _place(spark, "table")))


@query("a6_reference_csv_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a6(spark, sf):
    path = _place(spark, "reference")
    files.export_csv(table(spark, sf, "supplier"), path)
    out = files.read_reference_csv(spark, path)
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))


_SERVED = [*N.KEYS, N.RISK, N.HIGH_RISK, N.EXPECTED_PROFIT, N.ORDER_VALUE, N.MARGIN, N.SEGMENT]


def _served_tables(spark, sf):
    rows = segments(spark, sf).select(*_SERVED)
    return [
        publish.ServingTable("order_segments", rows, _SERVED, "gold", "Segmented order items"),
        publish.ServingTable("segment_rows", rows, [N.ORDER, N.ITEM, N.SEGMENT], "gold", "Segments only"),
        publish.ServingTable("suppliers", table(spark, sf, "supplier"), None, "reference", "Suppliers"),
    ]


_MANIFEST = """SELECT * FROM (SELECT '{p}order_segments' AS {n}, 'gold' AS artifact_category, (SELECT count(*) FROM lineitem) AS row_count, 9 AS column_count, 'success' AS run_status
UNION ALL SELECT '{p}segment_rows', 'gold', (SELECT count(*) FROM lineitem), 3, 'success'
UNION ALL SELECT '{p}suppliers', 'reference', (SELECT count(*) FROM supplier), 4, 'success')"""


@query("a7_publish_tables", _MANIFEST.format(p="riskloom_serving.", n="target_table"))
def a7(spark, sf):
    out = publish.publish_tables(spark, "riskloom_serving", _served_tables(spark, sf), _place(spark, "serving"))
    return out.drop("table_name", "description")


@query("a8_export_csv", _MANIFEST.format(p="", n="export_name"))
def a8(spark, sf):
    return publish.export_tables(_served_tables(spark, sf), _place(spark, "export"))


@query("a9_served_projection", O.scored("""SELECT Order_Id, Order_Item_Id, segment AS ao3_priority_segment, CAST(p AS DOUBLE) AS ao1_predicted_late_delivery_probability FROM seg"""))
def a9(spark, sf):
    rows = segments(spark, sf).select(*_SERVED)
    return doubles(publish.served_projection(rows, [N.ORDER, N.ITEM, N.SEGMENT, N.RISK]))


@query("a7_snapshot_reads", """SELECT s_suppkey, 2 * s_acctbal AS balance, 'new' AS version FROM supplier UNION ALL SELECT s_suppkey, s_acctbal, 'old' FROM supplier""")
def a7_snapshot(spark, sf):
    """A table published from its own last version, read in both versions."""
    root = _place(spark, "snapshots")
    given = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    old = publish.publish_snapshot(spark, root, [publish.ServingTable("suppliers", given)])
    doubled = old.read(spark, "suppliers").withColumn("balance", 2 * F.col("balance"))
    publish.publish_snapshot(spark, root, [publish.ServingTable("suppliers", doubled)])
    new = publish.open_snapshot(spark, root)
    return new.read(spark, "suppliers").withColumn("version", F.lit("new")).unionByName(
        old.read(spark, "suppliers").withColumn("version", F.lit("old")))
