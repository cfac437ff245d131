"""Price validity joins and cost projection.

A usage record is priced by the price-list version valid for it.  Two forms
exist in the source views and both are kept:

* ``containment`` (C1): equi keys ``cloud, sku_name``; the whole usage interval
  must lie inside the price interval (``start >= price_start`` and
  ``end <= price_end`` or the price is still open).  A record that straddles a
  price change matches no version and is dropped; price lists of several
  accounts fan out because ``account_id`` is not a key.
* ``point`` (C2): equi keys ``sku_name, cloud, usage_unit, account_id``; the
  usage start must fall in ``[price_start, price_end)``.

The join carries no hint: Spark broadcasts a price list whose measured bytes are
below its threshold, and otherwise shuffles on the equi keys, where AQE splits
the partitions of a hot SKU.  The range is a residual condition either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT, POINT = "containment", "point"
_KEYS = {CONTAINMENT: ["cloud", "sku_name"], POINT: ["sku_name", "cloud", "usage_unit", "account_id"]}


def price_join(usage: DataFrame, prices: DataFrame, mode: str = CONTAINMENT) -> DataFrame:
    """Inner join of usage to the valid price version.

    Adds ``price_start_time``, ``list_price`` (``pricing.default``) and
    ``effective_price`` (``pricing.effective_list.default``) to the usage columns.
    """
    if mode not in _KEYS:
        raise ValueError(f"unknown price join mode: {mode}")
    keys = _KEYS[mode]
    p = prices.select(
        *[F.col(k).alias(f"_p_{k}") for k in keys],
        F.col("price_start_time"),
        F.col("price_end_time").alias("_p_end"),
        F.col("pricing.default").alias("list_price"),
        F.col("pricing.effective_list.default").alias("effective_price"),
    )
    joined = usage.join(p, _condition(keys, mode), "inner")
    return joined.drop(*[f"_p_{k}" for k in keys], "_p_end")


def _condition(keys, mode) -> list[Column]:
    cond = [F.col(k) == F.col(f"_p_{k}") for k in keys]
    start, end = F.col("usage_start_time"), F.col("usage_end_time")
    cond.append(start >= F.col("price_start_time"))
    if mode == CONTAINMENT:
        cond.append((end <= F.col("_p_end")) | F.col("_p_end").isNull())
    else:
        cond.append(F.col("_p_end").isNull() | (start < F.col("_p_end")))
    return cond


def with_costs(priced: DataFrame) -> DataFrame:
    """D3: ``list_cost = quantity * list price``, ``effective_cost = quantity * effective price`` (decimal)."""
    q = F.col("usage_quantity")
    return priced.withColumns({"list_cost": q * F.col("list_price"),
                               "effective_cost": q * F.col("effective_price")})


def priced_usage(usage: DataFrame, prices: DataFrame, mode: str = CONTAINMENT) -> DataFrame:
    """Usage joined to its price with list and effective cost per record."""
    return with_costs(price_join(usage, prices, mode))
