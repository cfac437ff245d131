"""Deterministic replacements for ``first(x, true)``.

The source views take ``first(run_as, true)`` / ``first(custom_tags, true)``,
whose result depends on row order.  Here the pick is the smallest non-NULL
value (for tag maps: by their sorted entry list): always one of the values the
original could return, but the same on every run and in every engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS_KEY = "_tags_key"


def tags_order_key(tags) -> Column:
    """Key-order independent ordering key of a tag map: its entries sorted by (key, value).

    Built from code-generated expressions only (no lambda functions), as it is
    evaluated on every usage row.  NULL map -> NULL, empty map -> [].
    """
    return F.sort_array(F.map_entries(F.col(tags) if isinstance(tags, str) else tags))


def with_tags_key(df, tags_col: str = "custom_tags"):
    """Attach the ordering key used to pick among tag maps."""
    return df.withColumn(TAGS_KEY, tags_order_key(tags_col))


def pick_tags() -> Column:
    """The tag map with the smallest sorted entry list in the group (NULL maps skipped)."""
    return F.map_from_entries(F.min(TAGS_KEY)).alias("custom_tags")


def sum_then_pick(df: DataFrame, keys: Sequence[str], sums: Sequence[str], latest: Mapping[str, str] | None = None,
                  user: str | None = "run_as") -> DataFrame:
    """Sums, maxima, smallest user and tag pick per ``keys``, without sorting the rows of ``df``.

    Aggregates with text or array buffers cannot be hashed.  So the rows are first
    summed by keys, user and tags, which are grouping values there and leave only
    fixed-width buffers (a hash aggregate), and the picks run over those few rows.
    Returns the keys, ``sums``, ``custom_tags`` and its ordering key, the ``latest`` maxima under
    their new names, and ``user``.
    """
    users = [user] if user else []
    latest = dict(latest or {})
    combined = df.groupBy(*keys, *users, TAGS_KEY).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(name) for c, name in latest.items()])
    return combined.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(name).alias(name) for name in latest.values()],
        *[F.min(u).alias(u) for u in users], pick_tags(), F.min(TAGS_KEY).alias(TAGS_KEY))
