"""Model-serving cost views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOOKBACK_DAYS, OFFERING_BATCH_INFERENCE, PRODUCT_MODEL_SERVING, SKU_SERVERLESS_REAL_TIME_INFERENCE
from ..functions.dates import as_date, days_before
from ..operators.picks import pick_tags, sum_then_pick, with_tags_key
from ..operators.pricing import POINT, priced_usage
from .serverless import COSTS, SpendView, spend_view

ENTITY_COLS = ["endpoint_name", "endpoint_id", "created_by", "served_entity_name", "entity_type",
               "custom_model_config", "external_model_config"]


#: Entities of a block where C10 is stored row by row.
BLOCK_ENTITIES = 512
#: Joined rows below which the records of an endpoint are not cut further, and tiles of an endpoint a task gets beyond that.
TILE_ROWS = 65_536
TASK_TILES = 16


def join_served_entities(usage: DataFrame, served_entities: DataFrame, block_entities: int | None = None) -> DataFrame:
    """Usage joined to every entity served behind its endpoint (same account).

    An endpoint with N entities yields N rows per usage record.  Spark picks the
    join from measured sizes.

    ``block_entities`` is for a result that is stored row by row: every record meets the
    entities of its endpoint in blocks of about that many, joined block by block.  The same few names
    then repeat from record to record within a page of the file format, so a stored row
    takes a fraction of a byte.  The records of an endpoint are cut into chunks as well, and its tiles
    (chunk x block) are dealt to the tasks in turn, so every task joins about as many rows
    whether records or entities make an endpoint large.
    """
    ents = served_entities.where(F.col("endpoint_name").isNotNull()).select(
        F.col("account_id").alias("_e_account"), *ENTITY_COLS)
    endpoint, account = F.col("usage_metadata.endpoint_name"), F.col("account_id")
    if block_entities is None:
        return usage.join(ents, (endpoint == F.col("endpoint_name")) & (account == F.col("_e_account")), "inner").drop("_e_account")
    # the rows before the fan-out say little about those after it, so the number of tasks is fixed
    parts = int(usage.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, one = ["endpoint_name", "_e_account"], F.count(F.lit(1))
    usage = usage.where(endpoint.isNotNull() & account.isNotNull())
    served_by = (F.col("_endpoint") == F.col("endpoint_name")) & (account == F.col("_e_account"))
    records = usage.groupBy(endpoint.alias("endpoint_name"), account.alias("_e_account")).agg(one.alias("_records"))
    sizes = ents.groupBy(*key).agg(one.alias("_entities")).join(records, key, "left")
    blocks = F.ceil(F.col("_entities") / block_entities)
    # chunks cost a copy of the entities each, so no more than the tasks and the joined rows are worth
    worth = F.ceil(F.col("_records") * F.least("_entities", F.lit(block_entities)) / TILE_ROWS)
    chunks = F.least(F.ceil(F.lit(parts * TASK_TILES) / blocks), F.coalesce(worth, F.lit(1)), F.lit(parts))
    grid = sizes.select(*key, blocks.alias("_blocks"), chunks.alias("_chunks"))

    def placed(df: DataFrame, tile: str, part: str, *by: Column) -> DataFrame:
        return df.withColumn(part, F.pmod(F.hash(*by) + F.col(tile), F.lit(parts)).cast("int")).repartitionById(parts, F.col(part))

    # dealt in turn, whatever the rows hold, before they are copied; a row's partition, unlike its place in it, is the same when a task is repeated
    met = usage.withColumn("_endpoint", endpoint).join(grid, served_by, "inner").drop(*key)
    met = met.repartition(parts).withColumn("_chunk", F.pmod(F.spark_partition_id(), "_chunks"))
    met = met.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    met = met.withColumn("_tile", F.col("_chunk") * F.col("_blocks") + F.col("_block")).drop("_blocks", "_chunks", "_chunk", "_block")
    met = placed(met, "_tile", "_part", F.col("_endpoint"), account)
    ents = ents.join(grid, key).repartition(parts)
    ents = ents.withColumn("_e_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    ents = ents.withColumn("_e_tile", F.col("_e_chunk") * F.col("_blocks") + F.pmod(F.xxhash64(*ENTITY_COLS), "_blocks"))
    ents = placed(ents.select("_e_account", *ENTITY_COLS, "_e_tile"), "_e_tile", "_e_part", F.col("endpoint_name"), F.col("_e_account"))
    # a sort-merge join puts the records of a block one after the other; a broadcast would keep their order in the input
    same_tile = (F.col("_tile") == F.col("_e_tile")) & (F.col("_part") == F.col("_e_part"))
    return met.join(ents.hint("merge"), same_tile & served_by, "inner").drop("_endpoint", "_e_account", "_tile", "_e_tile", "_part", "_e_part")


def model_serving_costs(usage: DataFrame, prices: DataFrame, served_entities: DataFrame, as_of=None,
                        lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Real-time inference cost per workspace and served entity, with 7/14/30-day sums.

    Usage joins every entity served behind its endpoint (C10), so an endpoint
    with N entities contributes its cost to each of them.  Here ``t14d`` is
    cumulative (``date >= D-14``).

    Sums, maxima and the tag pick all commute with that fan-out, so priced
    usage is first reduced to one row per (workspace, account, endpoint) and
    only those rows are joined to the entities and re-aggregated: the
    multiplication applies to a handful of partial rows instead of every
    usage record.
    """
    d = as_date(as_of)
    u = usage.where(F.col("sku_name").like(SKU_SERVERLESS_REAL_TIME_INFERENCE)
                    & F.col("usage_quantity").isNotNull()
                    & F.col("usage_metadata.endpoint_name").isNotNull()
                    & (F.col("usage_date") >= days_before(as_of, lookback_days)))
    priced = with_tags_key(priced_usage(u, prices, POINT).where(F.col("effective_price").isNotNull()))
    date, lc, ec, zero = F.col("usage_date"), F.col("list_cost"), F.col("effective_cost"), F.lit(0)
    sums = {"total_list_cost": lc, "total_effective_cost": ec}
    for days in (7, 14, 30):
        recent = date >= F.date_sub(d, days)
        sums[f"t{days}d_list_cost"] = F.when(recent, lc).otherwise(zero)
        sums[f"t{days}d_effective_cost"] = F.when(recent, ec).otherwise(zero)
    endpoint = ["workspace_id", "account_id", "_endpoint"]
    partial = sum_then_pick(priced.withColumn("_endpoint", F.col("usage_metadata.endpoint_name")).withColumns(sums),
                            endpoint, list(sums), latest={"usage_date": "last_usage_date"}, user=None)
    partial = partial.withColumn("usage_metadata", F.struct(F.col("_endpoint").alias("endpoint_name"))).drop("_endpoint")
    fanned = join_served_entities(partial, served_entities)
    return fanned.groupBy("workspace_id", *ENTITY_COLS).agg(
        F.max("last_usage_date").alias("last_usage_date"), pick_tags(),
        *[F.sum(k).alias(k) for k in sums])


def _batch_inference() -> Column:
    return ((F.col("billing_origin_product") == PRODUCT_MODEL_SERVING)
            & (F.col("product_features.model_serving.offering_type") == OFFERING_BATCH_INFERENCE))


def _batch_keys() -> dict[str, Column]:
    return {"workspace_id": F.col("workspace_id"), "usage_date": F.col("usage_date"), "run_as": F.col("identity_metadata.run_as"),
            "custom_tags": F.col("custom_tags"), "endpoint_name": F.col("usage_metadata.endpoint_name")}


def _batch_totals(as_of) -> list[Column]:
    return [F.sum(c).alias(f"total_{c}") for c in COSTS]


BATCH_INFERENCE = SpendView(_batch_inference, _batch_keys, COSTS, _batch_totals, POINT)


def batch_inference_costs(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Batch-inference cost per workspace, day, user, tag set and endpoint."""
    return spend_view(BATCH_INFERENCE, usage, prices, as_of, lookback_days)
