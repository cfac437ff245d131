"""Date and time column helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(as_of) -> Column:
    """The report date as a DATE literal (``None`` -> ``current_date()``)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def days_before(as_of, n: int) -> Column:
    """``as_of - n days`` as a DATE."""
    return F.date_sub(as_date(as_of), n)


def midnight(d: Column) -> Column:
    """A DATE as the TIMESTAMP at its start (how SQL compares a date to a timestamp)."""
    return d.cast("timestamp")


def hour_floor(ts) -> Column:
    """``date_trunc('hour', ts)``."""
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (truncated toward zero)."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(-F.floor(-micros / 1_000_000)).cast("long")


def growth_pct(new: Column, base: Column) -> Column:
    """``(new - base) / base * 100`` in double precision; NULL when base is 0."""
    return F.try_divide((new - base).cast("double"), base.cast("double")) * 100
