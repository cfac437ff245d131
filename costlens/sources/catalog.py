"""Reading stored views: filtered reads, schemas and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import equal_or_in
from ..operators.topk import capped


def query_view(df: DataFrame, filters: Mapping[str, object] | None = None, limit: int | None = None,
               order: Sequence = ()) -> DataFrame:
    """A6 on a DataFrame: AND of ``col = value`` / ``col IN (...)`` filters (empty list and
    None ignored); with ``limit``, the first rows after ``order``.

    A filter on a column that ``df`` lacks, or a limit without an order, is an error.
    """
    unknown = sorted(set(filters or {}) - set(df.columns))
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    if limit is not None and not order:
        raise ValueError("a limit needs an order")
    out = equal_or_in(df, filters or {})
    return capped(out, limit, order) if limit is not None else out


def read_view(spark: SparkSession, name: str, filters: Mapping[str, object] | None = None,
              limit: int | None = None, order: Sequence = ()) -> DataFrame:
    """Filtered read of a stored view, all of it unless ``limit`` is given.  Filters are
    Column predicates (no SQL text is assembled), so they are pushed into the table scan."""
    return query_view(spark.table(name), filters, limit, order)


def describe_view(spark: SparkSession, name: str) -> DataFrame:
    """Column name and type of a stored view."""
    fields = spark.table(name).schema.fields
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields],
                                 "column_name string, data_type string")


def list_views(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a database."""
    tables = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return spark.createDataFrame([(t.name, t.database, t.tableType) for t in tables],
                                 "name string, database string, table_type string")
