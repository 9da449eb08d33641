"""Serving-table publication and export, with manifests.

Serving tables are published together: all are written as a new version beside what readers
see, then one commit record makes them the current ones.  A record is a small file that
is created or not, so readers see all tables of one version, whatever fails on the way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..session import shared_folder
from .files import export_csv, file_system

COMMITS = "_commits"


class PublishConflict(RuntimeError):
    """Another publication was committed in the meantime; the data written here is not visible."""


@dataclass(frozen=True)
class ServingTable:
    """What to publish: a name, its source and, optionally, the served columns in order."""

    name: str
    source: DataFrame
    columns: Sequence[str] | None = None
    category: str = "gold"
    description: str = ""


def served_projection(
    df: DataFrame, columns: Sequence[str] | None = None, forbidden: Sequence[str] = N.SERVED_FORBIDDEN
) -> DataFrame:
    """Ordered projection that refuses missing columns and realized outcomes."""
    leaked = sorted(set(forbidden) & set(df.columns))
    if leaked:
        raise ValueError(f"realized outcomes in a served table: {leaked}")
    if columns is None:
        return df
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing from the served source: {missing}")
    return df.select(*columns)


@dataclass(frozen=True)
class Snapshot:
    """One committed version: its number and, for each table, where it is stored and what it holds."""

    number: int
    tables: dict[str, dict]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        facts = self.tables[name]
        return spark.read.format(facts["format"]).load(facts["path"])


def _records(spark: SparkSession, root: str) -> dict[int, str]:
    """Number and path of each commit record."""
    fs, folder = file_system(spark, f"{root}/{COMMITS}")
    if not fs.exists(folder):
        return {}
    paths = [str(s.getPath().toString()) for s in fs.listStatus(folder)]
    return {int(p.rsplit("/", 1)[1][:-5]): p for p in paths if p.endswith(".json")}


def _read_record(spark: SparkSession, path: str) -> Snapshot | None:
    """A record that is not whole, as its writer is still at it or broke off, is no commit."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        content = json.loads(text)
    except ValueError:
        return None
    return Snapshot(content["number"], content["tables"])


def open_snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    """The newest committed version, or the given one; None if there is none."""
    found = _records(spark, root.rstrip("/"))
    for n in sorted(found, reverse=True):
        if number in (None, n) and (snapshot := _read_record(spark, found[n])):
            return snapshot
    return None


def _write_version(spark: SparkSession, root: str, tables: Sequence[ServingTable], fmt: str) -> dict[str, dict]:
    """Every table under a new name; rows are counted while they are written."""
    if len({t.name for t in tables}) < len(tables):
        raise ValueError("serving tables need different names")
    mark, out = uuid.uuid4().hex, {}
    for table in tables:
        path, seen = f"{root}/{table.name}/{mark}", Observation()
        rows = served_projection(table.source, table.columns)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).save(path)
        out[table.name] = {
            "path": path, "format": fmt, "row_count": seen.get["n"], "column_count": len(rows.columns),
            "artifact_category": table.category, "description": table.description,
        }
    return out


def publish_snapshot(
    spark: SparkSession, root: str, tables: Sequence[ServingTable], fmt: str = "parquet", base: Snapshot | None = None
) -> Snapshot:
    """Publish all tables as one version and return it.

    Tables that are not given stay those of the version before, so a part can be published too.  ``base`` is
    the version the sources were read from; without it, the newest one when the writing starts.  If another
    publication gets there first, nothing of this one is visible and ``PublishConflict`` is raised.
    """
    if not tables:
        raise ValueError("nothing to publish")
    root = root.rstrip("/")
    before = base or open_snapshot(spark, root)
    number = before.number + 1 if before else 1
    written = _write_version(spark, root, tables, fmt)
    snapshot = Snapshot(number, (before.tables if before else {}) | written)
    newest = max(_records(spark, root), default=0)
    if newest >= number and open_snapshot(spark, root, newest):
        raise PublishConflict(f"version {newest} of {root} was committed meanwhile")
    number = max(number, newest + 1)  # numbers of broken records are not used again
    snapshot = Snapshot(number, snapshot.tables)
    fs, path = file_system(spark, f"{root}/{COMMITS}/{number:012d}.json")
    try:
        stream = fs.create(path, False)  # fails if it exists
    except Exception as e:
        raise PublishConflict(f"version {number} of {root} was committed meanwhile") from e
    try:
        stream.write(json.dumps({"number": number, "tables": snapshot.tables}).encode())
    finally:
        stream.close()
    return snapshot


def expire_snapshots(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop all but the newest ``keep`` versions and the data that only they use; returns the folders that went.

    Data of publications that are under way is no committed version's and stays; what broken ones left can be
    told by its absence from all records.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    root = root.rstrip("/")
    found = _records(spark, root)
    whole = [s for n in sorted(found) if (s := _read_record(spark, found[n]))]
    used = {facts["path"] for s in whole[-keep:] for facts in s.tables.values()}
    gone = sorted({facts["path"] for s in whole[:-keep] for facts in s.tables.values()} - used)
    for s in whole[:-keep]:
        fs, path = file_system(spark, found[s.number])
        fs.delete(path, False)
    for folder in gone:
        fs, path = file_system(spark, folder)
        fs.delete(path, True)
    return gone


def snapshot_manifest(spark: SparkSession, snapshot: Snapshot, prefix: str = "") -> DataFrame:
    """One row for each table of a version."""
    rows = [(prefix + name, name, f["artifact_category"], f["description"], f["row_count"], f["column_count"], "success")
            for name, f in sorted(snapshot.tables.items())]
    return spark.createDataFrame(
        rows, "target_table STRING, table_name STRING, artifact_category STRING, description STRING, row_count LONG, column_count INT, run_status STRING")


def publish_tables(
    spark: SparkSession, schema: str, tables: Sequence[ServingTable], location: str | None = None
) -> DataFrame:
    """Publish all serving tables as one version, name them in the catalog and return the manifest.

    Catalog names are views of the committed version.  They are set after the commit, so a publication that fails
    before leaves every name at the version it had; ``open_snapshot`` never mixes versions.
    ``location`` is the shared folder of the versions, by default one beside the session's shared folder.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    snapshot = publish_snapshot(spark, location or f"{shared_folder(spark)}/published-{schema}", tables)
    for name in (t.name for t in tables):
        target, facts = f"{schema}.{name}", snapshot.tables[name]
        if spark.catalog.tableExists(target) and spark.catalog.getTable(target).tableType != "VIEW":
            spark.sql(f"DROP TABLE {target}")
        spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {facts['format']}.`{facts['path']}`")
    return snapshot_manifest(spark, Snapshot(snapshot.number, {t.name: snapshot.tables[t.name] for t in tables}), f"{schema}.")


def export_tables(tables: Sequence[ServingTable], folder: str) -> DataFrame:
    """CSV export of served projections; the manifest goes out as JSON beside them.

    A source that several tables are served from is worked out once and kept while they are written, with the
    columns they serve.  Rows are counted while they are written.
    """
    if not tables:
        raise ValueError("nothing to publish")
    served = [served_projection(t.source, t.columns) for t in tables]
    spark, facts, kept = served[0].sparkSession, [], {}
    try:
        for table, rows in zip(tables, served):
            shared = [s.columns for t, s in zip(tables, served) if t.source is table.source]
            if len(shared) > 1:
                if id(table.source) not in kept:
                    kept[id(table.source)] = table.source.select(*dict.fromkeys(c for cs in shared for c in cs)).persist()
                rows = kept[id(table.source)].select(*rows.columns)
            seen = Observation()
            export_csv(rows.observe(seen, F.count(F.lit(1)).alias("n")), f"{folder}/{table.name}")
            facts.append((table.name, table.category, seen.get["n"], len(rows.columns), "success"))
    finally:
        for rows in kept.values():
            rows.unpersist()
    manifest = spark.createDataFrame(
        facts, "export_name STRING, artifact_category STRING, row_count LONG, column_count INT, run_status STRING")
    manifest.write.mode("overwrite").json(f"{folder}/_manifest")
    return manifest
