"""Small tables and documents that a run publishes: scores, coverage, profiles, status. Each path has a commit log, so a
publish that fails leaves what was there, and readers see the old or the new."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .versions import Log


def publish(df: DataFrame, path: str) -> int:
    """Replace a snapshot table; returns its version."""
    return publish_run(df.sparkSession, {"table": df}, {}, path)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The snapshot, or None if there is none."""
    run = load_run(spark, path, version)
    return run[0].get("table") if run else None


def publish_document(spark: SparkSession, document: dict, path: str) -> int:
    """One JSON document; values without a JSON form become text."""
    return publish_run(spark, {}, document, path)


def load_document(spark: SparkSession, path: str) -> dict | None:
    """The document, or None if it is missing or broken."""
    entry = Log(spark, path).latest()[1]
    got = (entry or {}).get("document")
    return got if isinstance(got, dict) else None


def publish_run(spark: SparkSession, tables: dict[str, DataFrame], document: dict, path: str) -> int:
    """Tables and a document as one version: a reader never gets the tables of two runs. Old versions go in time.

    A value of document that is callable is called with the written tables, by name."""
    log = Log(spark, path)
    folders = {name: f"{log.new_folder()}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{log.root}/{folders[name]}")
    written = {name: spark.read.schema(df.schema).parquet(f"{log.root}/{folders[name]}") for name, df in tables.items()}
    document = {k: v(written) if callable(v) else v for k, v in document.items()}
    schemas = {name: df.schema.json() for name, df in tables.items()}
    version = log.append({"tables": folders, "schemas": schemas, "document": json.loads(json.dumps(document, default=str))})
    log.vacuum()
    return version


def load_run(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict] | None:
    """(tables, document) of a version, the newest without one; None if there is none or it is broken."""
    from pyspark.sql.types import StructType

    log = Log(spark, path)
    entry = log.latest()[1] if version is None else log.entry(version)
    if not entry or not isinstance(entry.get("tables"), dict):
        return None
    read = lambda name, folder: spark.read.schema(StructType.fromJson(json.loads(entry["schemas"][name]))).parquet(f"{log.root}/{folder}")
    return {name: read(name, folder) for name, folder in entry["tables"].items()}, entry.get("document", {})
