"""Scans of the billing, job and serving tables (A1–A5).

Each reader takes either a catalog table name or a Parquet path.  Reading with
an explicit schema avoids inference; date filters written against
``usage_date`` reach the scan as pushed filters (and prune partitions when the
table is partitioned by ``usage_date``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def read_table(spark: SparkSession, location: str, schema=None) -> DataFrame:
    """Read a catalog table by name, or Parquet files by path."""
    if "/" in location or location.endswith(".parquet"):
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(location)
    df = spark.table(location)
    return df.select(*schema.fieldNames()) if schema is not None else df


def usage(spark: SparkSession, location: str) -> DataFrame:
    """A1: metered usage records."""
    return read_table(spark, location, schemas.USAGE)


def list_prices(spark: SparkSession, location: str) -> DataFrame:
    """A2: price history, one row per SKU price version."""
    return read_table(spark, location, schemas.LIST_PRICES)


def jobs(spark: SparkSession, location: str) -> DataFrame:
    """A3: job definitions, one row per change (slowly changing)."""
    return read_table(spark, location, schemas.JOBS)


def job_run_timeline(spark: SparkSession, location: str) -> DataFrame:
    """A4: time slices of job runs; ``result_state`` is set on terminal slices."""
    return read_table(spark, location, schemas.JOB_RUN_TIMELINE)


def served_entities(spark: SparkSession, location: str) -> DataFrame:
    """A5: entities served behind model-serving endpoints."""
    return read_table(spark, location, schemas.SERVED_ENTITIES)


def clusters(spark: SparkSession, location: str) -> DataFrame:
    """Cluster listing snapshot (id, name, state, custom tags)."""
    return read_table(spark, location, schemas.CLUSTERS)


def warehouses(spark: SparkSession, location: str) -> DataFrame:
    """SQL warehouse listing snapshot."""
    return read_table(spark, location, schemas.WAREHOUSES)


def job_settings(spark: SparkSession, location: str) -> DataFrame:
    """Job listing snapshot (settings hold the name and tags)."""
    return read_table(spark, location, schemas.JOB_SETTINGS)


def pipelines(spark: SparkSession, location: str) -> DataFrame:
    """Pipeline listing snapshot (spec holds the name and configuration)."""
    return read_table(spark, location, schemas.PIPELINES)
