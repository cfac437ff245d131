"""Top-k and capped reads.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own k best rows and only those reach the final merge, so a top-k never
sorts or moves the whole input.  Ties are broken by key columns so the row
set is unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``metric`` (NULL metrics excluded).

    Ties are broken by ``keys`` ascending (NULL first).
    """
    order = [F.col(metric).desc()] + [F.col(c).asc_nulls_first() for c in keys]
    return df.where(F.col(metric).isNotNull()).orderBy(*order).limit(k)


def top_groups(df: DataFrame, k: int, group: str | Sequence[str], metric: str, agg: str = "sum",
               alias: str | None = None) -> DataFrame:
    """E9 + G3: aggregate ``metric`` per group (NULL group keys dropped), keep the top ``k`` groups.

    The sum of a group without any value is 0, so the group stays.
    """
    groups = [group] if isinstance(group, str) else list(group)
    out = alias or metric
    kept = df.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups]))
    fn = {"sum": lambda m: F.coalesce(F.sum(m), F.lit(0)), "max": F.max, "count": F.count}[agg]
    return top_k(kept.groupBy(*groups).agg(fn(metric).alias(out)), k, out, groups)


def safe_top_k(df: DataFrame, k: int, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Top-k after coercing a text metric to a number; a missing column leaves ``df`` unchanged."""
    if metric not in df.columns:
        return df
    coerced = df.withColumn(metric, F.col(metric).try_cast("double")) \
        if dict(df.dtypes)[metric] == "string" else df
    return top_k(coerced, k, metric, keys)


def capped(df: DataFrame, limit: int, order: Sequence = ()) -> DataFrame:
    """At most ``limit`` rows, taken after ordering when an order is given."""
    return (df.orderBy(*order) if order else df).limit(limit)
