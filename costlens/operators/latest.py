"""Latest version per key (F1).

``ROW_NUMBER() OVER (PARTITION BY key ORDER BY change_time DESC) = 1`` is
expressed as two aggregates, both combined map-side before their shuffle.  The
history is first reduced to the greatest leading order value per key and other
columns: text is a grouping value there and the only buffer has fixed width, so
it is a hash aggregate and no task sorts versions.  The greatest ``struct`` per
key, which Spark can only aggregate by sorting, then runs over the few distinct
contents a key ever had.  Ties on ``change_time`` are broken by the remaining
fields (descending), NULL ordering values lose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order`` tuple.

    Returns ``keys + order + payload`` columns.  ``order`` fields are compared
    left to right, descending, NULL smallest; ``payload`` fields act as further
    tie-breaks in the order given.
    """
    fields = list(order) + [c for c in payload if c not in order]
    lead, rest = fields[0], fields[1:]
    contents = df.groupBy(*keys, *rest).agg(F.max(lead).alias(lead))
    best = F.max(F.struct(*[F.col(c) for c in fields])).alias("_best")
    return contents.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in fields])


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Latest definition of each job: ``workspace_id, job_id, change_time, name``."""
    return latest_by(jobs, ["workspace_id", "job_id"], ["change_time"], ["name"])
