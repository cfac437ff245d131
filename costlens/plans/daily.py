"""Stored sums of days, from which the spend views are assembled (B2 without rescanning the window).

A view of :data:`DAILY_VIEWS` sums exact decimals over a window of days, so it is the
sum of its days.  :func:`advance_days` prices and sums usage of single days and stores
one row per (day, keys of the view); :func:`from_days` assembles the view from the
days of its window with the view's own totals.  A refresh reads usage only of the
days that have no sums yet and of those named as changed: late records, corrected
records, or days whose prices were changed.

The sums lie in the folder ``daily/<view>`` of the database, one folder per step and day:
``step=<id>/usage_date=<day>``.  Which step holds a day is said by the table
``<view>__days`` (one row per day), a versioned table with the commit record of
:mod:`costlens.plans.refresh`: a step becomes visible as a whole, of two writers
the second is refused, and a day recomputed without rows loses its old sums.  Files of
a step that no day uses any more are removed by the commit after the next.

Edge cases: usage without a day is in no window and in no sum; a day without usage
counts as computed; days after the report date are computed only when named as
changed; a view never advanced has no days and :func:`from_days` raises ``LookupError``,
as it does when a day of the window has no sums.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import LOOKBACK_DAYS
from ..operators.pricing import priced_usage
from .refresh import (VIEWS, RefreshConflict, begin_version, commit_version, database_location, folder, materialize,
                      refresh_all, view_order)
from .run_state import advance_runs, stored_run_totals
from .serverless import SPEND_VIEWS, SpendView, spend_view
from .serving import BATCH_INFERENCE

DAILY_VIEWS: dict[str, SpendView] = {**SPEND_VIEWS, "batch_inference_costs": BATCH_INFERENCE}

_MANIFEST = "usage_date date, step string, live boolean"


def report_date(spark: SparkSession, as_of) -> dt.date:
    """The report date as a Python date (``None``: today in the session's time zone)."""
    if as_of is None:
        return spark.range(1).select(F.current_date()).first()[0]
    return dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def window_days(spark: SparkSession, as_of, lookback_days: int = LOOKBACK_DAYS) -> list[dt.date]:
    """The days from ``as_of - lookback_days`` to ``as_of``."""
    last = report_date(spark, as_of)
    return [last - dt.timedelta(days=n) for n in range(lookback_days, -1, -1)]


def day_sums(view: SpendView, usage: DataFrame, prices: DataFrame, days: Iterable[dt.date]) -> DataFrame:
    """``usage_date``, the keys and the summed measures of a view for some days; only their usage is read."""
    rows = usage.where(F.col("usage_date").isin(list(days)) & view.rows())
    sums = [F.sum(m).alias(m) for m in view.measures]
    priced = priced_usage(rows, prices, view.price_mode)
    keys = [c.alias(name) for name, c in view.keys().items() if name != "usage_date"]
    return priced.groupBy("usage_date", *keys).agg(*sums)


def _place(spark: SparkSession, name: str, database: str | None) -> tuple[str, str]:
    """The table of days and the folder of sums of a view."""
    table = f"{name}__days"
    return f"{database}.{table}" if database else table, f"{database_location(spark, database)}/daily/{name}"


def _manifest(spark: SparkSession, table: str) -> tuple[dict[dt.date, str], list[str]]:
    """Step of each day, and the steps no longer in use; one row per day ever kept."""
    if not spark.catalog.tableExists(table):
        return {}, []
    rows = spark.table(table).collect()
    return {r["usage_date"]: r["step"] for r in rows if r["live"]}, [r["step"] for r in rows if not r["live"]]


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = folder(spark, path)
    fs.delete(where, True)


def advance_days(spark: SparkSession, name: str, usage: DataFrame, prices: DataFrame, as_of=None, database: str | None = None,
                 changed: Iterable[dt.date] = (), lookback_days: int = LOOKBACK_DAYS) -> list[dt.date]:
    """Store the sums of the window's days that have none and of the ``changed`` days; returns the days computed.

    Days before the window are forgotten.
    """
    table, store = _place(spark, name, database)
    version = begin_version(spark, table)  # before the days are read: a commit in between refuses this one
    days, retired = _manifest(spark, table)
    window = window_days(spark, as_of, lookback_days)
    todo = sorted({d for d in window if d not in days} | {d for d in changed if d >= window[0]})
    kept = {d: s for d, s in days.items() if d >= window[0]}
    if not todo and kept == days:
        return []
    step = f"s{uuid.uuid4().hex}"
    if todo:
        sums = day_sums(DAILY_VIEWS[name], usage, prices, todo)
        sums.hint("rebalance", "usage_date").write.partitionBy("usage_date").parquet(f"{store}/step={step}")
    now = {**kept, **dict.fromkeys(todo, step)}
    unused = sorted(set(days.values()) - set(now.values()))
    rows = [(d, s, True) for d, s in sorted(now.items())] + [(None, s, False) for s in unused]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.saveAsTable(version.table)
    try:
        commit_version(spark, version)
    except RefreshConflict:
        _remove(spark, f"{store}/step={step}")
        raise
    for old in retired:
        _remove(spark, f"{store}/step={old}")
    return todo


def stored_sums(spark: SparkSession, name: str, usage: DataFrame, prices: DataFrame, as_of=None, database: str | None = None,
                lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """The stored sums of all days from the first day of the window on."""
    table, store = _place(spark, name, database)
    days, _ = _manifest(spark, table)
    window = window_days(spark, as_of, lookback_days)
    missing = [d for d in window if d not in days]
    if missing:
        raise LookupError(f"{name}: no sums of {len(missing)} days, the first {missing[0]}; advance_days computes them")
    of_step: dict[str, list[dt.date]] = {}
    for day, step in days.items():
        if day >= window[0]:
            of_step.setdefault(step, []).append(day)
    schema = day_sums(DAILY_VIEWS[name], usage, prices, window).schema.add("step", "string")  # analysis only
    read = spark.read.schema(schema).option("basePath", store).parquet(*(f"{store}/step={s}" for s in of_step))
    in_force = F.lit(False)
    for step, own in of_step.items():  # partition filters
        in_force = in_force | ((F.col("step") == step) & F.col("usage_date").isin(own))
    return read.where(in_force).drop("step")


def from_days(spark: SparkSession, name: str, usage: DataFrame, prices: DataFrame, as_of=None, database: str | None = None,
              lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """The view ``name`` assembled from its stored days, with the columns and types of the view itself.

    ``usage`` and ``prices`` only give the types; none of their rows are read.
    """
    view, last = DAILY_VIEWS[name], report_date(spark, as_of)
    full = spend_view(view, usage, prices, last, lookback_days).schema
    sums = stored_sums(spark, name, usage, prices, last, database, lookback_days)
    keys = list(view.keys())
    return sums.groupBy(*keys).agg(*view.totals(last)).select(*(F.col(f.name).cast(f.dataType) for f in full.fields))


def refresh_by_day(spark: SparkSession, tables: dict[str, DataFrame], as_of=None, database: str | None = None,
                   changed: Iterable[dt.date] = (), views: Sequence[str] | None = None,
                   new_slices: DataFrame | None = None) -> list[str]:
    """B2 with stored days: as :func:`refresh_all`, but J6-J12 and J14 read usage only of new and ``changed`` days.

    With ``new_slices``, the timeline slices delivered since the last refresh, J5 takes its run totals
    from the stored state, to which they are added first.
    """
    names, changed = list(views or VIEWS), list(changed)
    if new_slices is not None:
        advance_runs(spark, new_slices, database)
        tables = {**tables, "_run_totals": stored_run_totals(spark, new_slices, database)}
    usage, prices = tables["usage"], tables["list_prices"]
    others = [n for n in names if n not in DAILY_VIEWS]
    written = refresh_all(spark, tables, as_of, database, others) if others else []
    for name in names:
        if name in DAILY_VIEWS:
            advance_days(spark, name, usage, prices, as_of, database, changed)
            df = from_days(spark, name, usage, prices, as_of, database)
            written.append(materialize(df, f"{database}.{name}" if database else name, order=view_order(name, df)))
    return written
