"""Position of every row in a global order (G1), without a window over a single partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted within them: what is written from it has one
    range a file, so a filter on the leading column or a limit reads few files."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in ``order`` (from 1; ``order`` has to be total).

    Rows are dealt by ranges of the order and checkpointed once; the rows of the
    ranges before give the first place of a range, and a window per range numbers
    its rows.  Only one row per range meets in a single partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = (dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
             .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return (dealt.withColumn(name, place).join(first, "_range")
            .withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before"))
