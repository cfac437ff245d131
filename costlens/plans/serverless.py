"""Serverless and per-user spend views.

Each view is a :class:`SpendView`: which usage rows it reads, its keys by name and its
totals.  The same description serves a view over the whole window and the sums
of single days that :mod:`costlens.plans.daily` stores.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (LOOKBACK_DAYS, PRODUCT_INTERACTIVE, PRODUCT_JOBS, SKU_JOBS_SERVERLESS_COMPUTE, SKU_SERVERLESS,
                     UNIT_DBU)
from ..functions.dates import as_date, days_before
from ..operators.pricing import CONTAINMENT, priced_usage

COSTS = ("list_cost", "effective_cost")
DBU_COSTS = ("usage_quantity", *COSTS)


class SpendView(NamedTuple):
    """A view of summed spend: ``rows`` of usage without the window, ``keys``, ``totals`` of the ``measures`` for a report date."""

    rows: Callable[[], Column]
    keys: Callable[[], dict[str, Column]]
    measures: tuple[str, ...]
    totals: Callable[[object], list[Column]]
    price_mode: str = CONTAINMENT


def spend_view(view: SpendView, usage: DataFrame, prices: DataFrame, as_of, lookback_days: int) -> DataFrame:
    """The view over all usage of the window."""
    rows = usage.where(view.rows() & (F.col("usage_date") >= days_before(as_of, lookback_days)))
    keys = [c.alias(name) for name, c in view.keys().items()]
    return priced_usage(rows, prices, view.price_mode).groupBy(*keys).agg(*view.totals(as_of))


def _job() -> dict[str, Column]:
    return {"job_id": F.col("usage_metadata.job_id"), "job_name": F.col("usage_metadata.job_name")}


def _notebook() -> dict[str, Column]:
    return {"notebook_id": F.col("usage_metadata.notebook_id"), "notebook_path": F.col("usage_metadata.notebook_path")}


def _run_as() -> dict[str, Column]:
    return {"run_as": F.col("identity_metadata.run_as")}


def _spend_alert_aggs(as_of) -> list[Column]:
    """Totals, last 7 days (``date >= D-7``) and the week before (``D-14 <= date < D-7``)."""
    d = as_date(as_of)
    date = F.col("usage_date")
    last7 = date >= F.date_sub(d, 7)
    prev7 = (date >= F.date_sub(d, 14)) & (date < F.date_sub(d, 7))
    lc, ec = F.col("list_cost"), F.col("effective_cost")
    zero = F.lit(0)
    return [
        F.sum(lc).alias("list_cost"),
        F.sum(ec).alias("effective_cost"),
        F.sum(F.when(last7, lc).otherwise(zero)).alias("t7d_list_cost"),
        F.sum(F.when(last7, ec).otherwise(zero)).alias("t7d_effective_cost"),
        F.sum(F.when(prev7, lc).otherwise(zero)).alias("t14d_list_cost"),
        F.sum(F.when(prev7, ec).otherwise(zero)).alias("t14d_effective_cost"),
    ]


def _cost_aggs(as_of) -> list[Column]:
    return [F.sum(c).alias(c) for c in COSTS]


def _dbu_aggs(as_of) -> list[Column]:
    return [F.sum("usage_quantity").alias("total_dbu"),
            F.sum("list_cost").alias("list_cost"),
            F.sum("effective_cost").alias("effective_cost")]


def _serverless(*products: str) -> Column:
    return F.col("sku_name").like(SKU_SERVERLESS) & F.col("billing_origin_product").isin(*products)


def _serverless_dbu() -> Column:
    return (F.col("billing_origin_product").isin(PRODUCT_JOBS, PRODUCT_INTERACTIVE)
            & F.col("product_features.is_serverless") & (F.col("usage_unit") == UNIT_DBU))


def _notebook_dbu() -> Column:
    return (F.col("usage_metadata.notebook_id").isNotNull() & (F.col("billing_origin_product") == PRODUCT_INTERACTIVE)
            & F.col("product_features.is_serverless") & (F.col("usage_unit") == UNIT_DBU))


def _job_dbu() -> Column:
    return (F.col("usage_metadata.job_id").isNotNull() & (F.col("usage_unit") == UNIT_DBU)
            & F.col("sku_name").like(SKU_JOBS_SERVERLESS_COMPUTE))


SPEND_VIEWS: dict[str, SpendView] = {
    "workspace_spend_alerts": SpendView(lambda: _serverless(PRODUCT_JOBS, PRODUCT_INTERACTIVE),
                                        lambda: {"workspace_id": F.col("workspace_id")}, COSTS, _spend_alert_aggs),
    "user_spend_alerts": SpendView(lambda: _serverless(PRODUCT_JOBS, PRODUCT_INTERACTIVE),
                                   _run_as, COSTS, _spend_alert_aggs),
    "job_spend_alerts": SpendView(lambda: _serverless(PRODUCT_JOBS), lambda: {"workspace_id": F.col("workspace_id"), "job_id": F.col("usage_metadata.job_id")},
                                  COSTS, _cost_aggs),
    "serverless_notebook_spend": SpendView(_notebook_dbu, lambda: {**_notebook(), **_run_as()}, DBU_COSTS, _dbu_aggs),
    "serverless_job_spend": SpendView(_job_dbu, _job, DBU_COSTS, _dbu_aggs),
    "user_serverless_consumption": SpendView(_serverless_dbu, lambda: {**_job(), **_notebook(), **_run_as()},
                                             DBU_COSTS, _dbu_aggs),
    "serverless_consumption_by_tag": SpendView(_serverless_dbu, lambda: {**_job(), **_notebook(), "custom_tags": F.col("custom_tags")},
                                               DBU_COSTS, _dbu_aggs),
}


def workspace_spend_alerts(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless job + interactive spend per workspace with weekly split."""
    return spend_view(SPEND_VIEWS["workspace_spend_alerts"], usage, prices, as_of, lookback_days)


def user_spend_alerts(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """As J6 per user (``run_as``; a NULL user is its own group)."""
    return spend_view(SPEND_VIEWS["user_spend_alerts"], usage, prices, as_of, lookback_days)


def job_spend_alerts(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless job spend per workspace and job."""
    return spend_view(SPEND_VIEWS["job_spend_alerts"], usage, prices, as_of, lookback_days)


def serverless_notebook_spend(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless interactive DBUs and cost per notebook and user."""
    return spend_view(SPEND_VIEWS["serverless_notebook_spend"], usage, prices, as_of, lookback_days)


def serverless_job_spend(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless jobs-compute DBUs and cost per job."""
    return spend_view(SPEND_VIEWS["serverless_job_spend"], usage, prices, as_of, lookback_days)


def user_serverless_consumption(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless DBUs and cost per job, notebook and user."""
    return spend_view(SPEND_VIEWS["user_serverless_consumption"], usage, prices, as_of, lookback_days)


def serverless_consumption_by_tag(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Serverless DBUs and cost per job, notebook and tag set (map key)."""
    return spend_view(SPEND_VIEWS["serverless_consumption_by_tag"], usage, prices, as_of, lookback_days)
