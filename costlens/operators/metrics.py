"""One-pass summary metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(col: str) -> Column:
    """Mean of the non-NULL values as ``sum / count`` in double precision (NULL when none).

    The sum is exact (decimal) before the one division, so the result does not
    depend on how rows are split across tasks.
    """
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def summary(df: DataFrame, metrics: Sequence[Column]) -> DataFrame:
    """One row of global metrics computed in a single aggregate pass."""
    return df.agg(*metrics)


def mean_of_group_sums(df: DataFrame, group: str, metric: str, alias: str) -> DataFrame:
    """Average over groups (NULL group keys dropped) of the per-group sum."""
    per_group = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(metric).alias("_g"))
    return per_group.agg(mean("_g").alias(alias))
