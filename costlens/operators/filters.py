"""Membership, tag and date-relative filters.

All filters are ``Column`` predicates, so Catalyst pushes them as far down as
the plan allows (into the Parquet scan for stored views).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _predicate(col: str, selection) -> Column | None:
    if not selection:  # None, '', 0 and an empty list select everything
        return None
    if isinstance(selection, (list, tuple, set, frozenset)):
        return F.col(col).isin(*selection)
    return F.col(col) == F.lit(selection)


def equal_or_in(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """AND of ``col = value`` / ``col IN (values)``; only None and empty lists are no filter,
    so ``''``, ``0`` and ``False`` are compared."""
    for name, wanted in filters.items():
        if isinstance(wanted, (list, tuple, set, frozenset)):
            df = df.where(F.col(name).isin(*wanted)) if wanted else df
        elif wanted is not None:
            df = df.where(F.col(name) == F.lit(wanted))
    return df


def filter_in(df: DataFrame, selections: Mapping[str, object]) -> DataFrame:
    """AND of ``col IN values`` (list) / ``col = value`` (scalar).

    Empty and falsy selections select everything; columns missing from ``df`` are ignored.
    """
    preds = [p for c, s in selections.items() if c in df.columns for p in [_predicate(c, s)] if p is not None]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def filter_tag(df: DataFrame, key: str | None, values: Sequence[str] | None, tags_col: str = "custom_tags") -> DataFrame:
    """Rows whose tag ``key`` is present with a value in ``values`` (no-op unless both are given)."""
    if not key or not values:
        return df
    return df.where(F.element_at(F.col(tags_col), F.lit(key)).isin(*list(values)))


def since_latest(df: DataFrame, date_col: str, days: int) -> DataFrame:
    """Rows with ``date_col >= max(date_col) - days``.

    The maximum is a scalar subquery (one partial aggregate per task), not a
    join or a global window.
    """
    latest = df.select(F.max(date_col)).scalar()
    return df.where(F.col(date_col) >= F.date_sub(latest, days))
