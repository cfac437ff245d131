"""Test-input tables derived from the driver's Parquet files.

The cost views read billing-style tables (usage, price list, jobs, run
timeline, served entities, resource snapshots).  The test data ships TPC-H
style tables plus an ``events`` stream, so this module maps those rows onto
the billing schemas, one output row per input row, exactly as written in
FIXTURES.md.  It only shapes rows; every measure is computed by the library.
The same derivation is repeated in SQL by the DuckDB oracle
(:mod:`costlens.suite.oracle`).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

# Fixed values of the fixture price list: SKU base prices, the price change
# instant and its multiplier, and the effective-price discount.
SKU_BASE_PRICES = [
    ("PREMIUM_JOBS_SERVERLESS_COMPUTE_US", "0.35"),
    ("PREMIUM_ALL_PURPOSE_SERVERLESS_COMPUTE_US", "0.75"),
    ("PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_US", "0.07"),
    ("PREMIUM_JOBS_COMPUTE", "0.15"),
]
CLOUDS = ["AWS", "AZURE"]
PRICE_VERSIONS = [("2023-01-01 00:00:00", "2024-01-15 12:30:00", "1.0"), ("2024-01-15 12:30:00", None, "1.1")]
EFFECTIVE_DISCOUNT = "0.8"
ACCOUNT, OTHER_ACCOUNT = "acct-1", "acct-2"


def _s(c: Column) -> Column:
    return c.cast("string")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    eid, uid, et, ts = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("ts")
    hour = F.date_trunc("hour", ts)
    no_job = et.isin("view", "signup") | (eid % 101 == 0)
    tags_json = F.when(eid % 13 == 0, F.lit(None)).otherwise(
        F.concat(F.lit('{"env":"'), F.when(uid % 2 == 0, "prod").otherwise("dev"),
                 F.lit('","team":"t'), _s(uid % 5), F.lit('"}')))
    df = ev.select(
        eid.alias("record_id"),
        F.when(eid % 19 == 0, OTHER_ACCOUNT).otherwise(ACCOUNT).alias("account_id"),
        _s(uid % 4).alias("workspace_id"),
        F.when(uid % 3 == 0, "AWS").otherwise("AZURE").alias("cloud"),
        F.when(et == "click", "PREMIUM_JOBS_SERVERLESS_COMPUTE_US")
         .when(et == "view", "PREMIUM_ALL_PURPOSE_SERVERLESS_COMPUTE_US")
         .when(et == "signup", "PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_US")
         .otherwise("PREMIUM_JOBS_COMPUTE").alias("sku_name"),
        F.when(et == "view", "INTERACTIVE").when(et == "signup", "MODEL_SERVING")
         .otherwise("JOBS").alias("billing_origin_product"),
        F.when(eid % 17 == 0, "GB").otherwise("DBU").alias("usage_unit"),
        F.when(eid % 23 == 0, -F.col("value")).otherwise(F.col("value")).cast(schemas.MONEY_QTY).alias("usage_quantity"),
        hour.cast("timestamp").alias("usage_start_time"),
        (hour + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("usage_end_time"),
        ts.cast("date").alias("usage_date"),
        F.from_json(tags_json, schemas.TAGS).alias("custom_tags"),
        F.struct(
            F.when(no_job, F.lit(None)).otherwise(_s(uid)).alias("job_id"),
            F.when(no_job, F.lit(None)).otherwise(
                F.concat(_s(uid), F.lit("-"), _s(ts.cast("date")))).alias("job_run_id"),
            F.when((et == "click") & (eid % 5 != 0), F.concat(F.lit("job-"), _s(uid))).alias("job_name"),
            F.when(et == "view", _s(uid % 20)).alias("notebook_id"),
            F.when(et == "view", F.concat(F.lit("/nb/"), _s(uid % 20))).alias("notebook_path"),
            F.when(et == "signup", F.concat(F.lit("ep-"), _s(uid % 5))).alias("endpoint_name"),
        ).alias("usage_metadata"),
        F.struct(F.when(eid % 11 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("user"), _s(uid % 40), F.lit("@x.io"))).alias("run_as")).alias("identity_metadata"),
        F.struct(
            et.isin("click", "view", "signup").alias("is_serverless"),
            F.struct(F.when((et == "signup") & (eid % 3 == 0), "BATCH_INFERENCE").alias("offering_type"))
             .alias("model_serving"),
        ).alias("product_features"),
    )
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.USAGE.fields])


def list_prices(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The fixture price list (a parameter table: 4 SKUs x 2 clouds x 2 versions)."""
    rows = []
    for sku, base in SKU_BASE_PRICES:
        for cloud in CLOUDS:
            for start, end, mult in PRICE_VERSIONS:
                lp = (Decimal(base) * Decimal(mult)).quantize(Decimal("0.0001"))
                ep = (Decimal(base) * Decimal(mult) * Decimal(EFFECTIVE_DISCOUNT)).quantize(Decimal("0.0001"))
                rows.append((ACCOUNT, cloud, sku, "DBU", start, end, lp, ep))
    names = [f.name for f in schemas.LIST_PRICES.fields]
    # literals, so that Spark knows how small the table is
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r[:6])],
                               F.struct(F.lit(r[6]).alias("default"),
                                        F.struct(F.lit(r[7]).alias("default")).alias("effective_list")).alias("pricing"))
                      for r in rows])
    listed = spark.range(1).select(F.explode(table).alias("p")).select("p.*")
    return listed.select(*[F.col(f.name).cast(f.dataType) for f in schemas.LIST_PRICES.fields])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        _s(uid % 4).alias("workspace_id"),
        _s(uid).alias("job_id"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("job-"), _s(uid), F.lit("-v"), _s(eid % 5))).alias("name"),
        F.col("ts").cast("timestamp").alias("change_time"),
    )


def job_run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    eid, uid, et, ts = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("ts")
    return ev.select(
        eid.alias("slice_id"),
        _s(uid % 4).alias("workspace_id"),
        F.when(eid % 89 != 0, _s(uid)).alias("job_id"),
        F.when(eid % 83 != 0, F.concat(_s(uid), F.lit("-"), _s(ts.cast("date")))).alias("run_id"),
        ts.cast("timestamp").alias("period_start_time"),
        F.when(eid % 9 == 0, ts + F.expr("INTERVAL 190 MINUTES")).otherwise(ts + F.expr("INTERVAL 20 MINUTES"))
         .cast("timestamp").alias("period_end_time"),
        F.when(et == "purchase", "SUCCEEDED")
         .when((et == "error") & (eid % 4 == 0), "TIMED_OUT")
         .when((et == "error") & (eid % 4 == 1), "CANCELLED")
         .when(et == "error", "FAILED").alias("result_state"),
    )


def served_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return sp.select(
        F.when(k % 11 == 0, OTHER_ACCOUNT).otherwise(ACCOUNT).alias("account_id"),
        F.concat(F.lit("ep-"), _s(k % 5)).alias("endpoint_name"),
        F.concat(F.lit("id-"), _s(k % 5)).alias("endpoint_id"),
        F.concat(F.lit("owner"), _s(k % 3), F.lit("@x.io")).alias("created_by"),
        F.col("s_name").alias("served_entity_name"),
        F.when(k % 3 == 0, "CUSTOM_MODEL").when(k % 3 == 1, "EXTERNAL_MODEL")
         .otherwise("FOUNDATION_MODEL").alias("entity_type"),
        F.when(k % 3 == 0, '{"v":1}').alias("custom_model_config"),
        F.when(k % 3 == 1, '{"p":"x"}').alias("external_model_config"),
    )


def _tags(json_col: Column) -> Column:
    return F.from_json(json_col, schemas.TAGS)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tags = (F.when(k % 4 == 0, F.lit(None))
            .when(k % 4 == 1, F.concat(F.lit('{"environment":"production","team":"'), F.col("c_mktsegment"), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"environment":"development","team":"'), F.col("c_mktsegment"),
                                F.lit('","owner":"o'), _s(k % 6), F.lit('"}'))))
    return c.select(_s(k).alias("cluster_id"), F.col("c_name").alias("cluster_name"),
                    F.when(k % 9 == 0, F.lit(None)).otherwise(F.lit("RUNNING")).alias("state"),
                    _tags(tags).alias("custom_tags"))


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(_s(k).alias("warehouse_id"), F.col("s_name").alias("name"), F.lit("STOPPED").alias("state"),
                    F.when(k % 3 == 0, "Small").when(k % 3 == 1, "Large").alias("cluster_size"),
                    _tags(F.when(k % 2 == 0, '{"environment":"production"}')).alias("tags"))


def job_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tags = F.concat(F.lit('{"team":"'), F.col("p_brand"), F.lit('","owner":"o'), _s(F.col("p_size") % 6), F.lit('"}'))
    settings = F.struct(F.col("p_name").alias("name"), _tags(tags).alias("tags"))
    no_settings = F.lit(None).cast(schemas.JOB_SETTINGS["settings"].dataType)
    creator = F.concat(F.lit("creator"), _s(F.col("p_size") % 7), F.lit("@x.io"))
    return p.select(_s(k).alias("job_id"), creator.alias("creator_user_name"), F.when(k % 10 == 0, no_settings).otherwise(settings).alias("settings"))


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    spec = F.struct(F.col("n_name").alias("name"), F.lit(None).cast(schemas.TAGS).alias("configuration"))
    no_spec = F.lit(None).cast(schemas.PIPELINES["spec"].dataType)
    return n.select(_s(F.col("n_nationkey")).alias("pipeline_id"), F.lit("IDLE").alias("state"),
                    F.when(F.col("n_nationkey") % 5 == 4, no_spec).otherwise(spec).alias("spec"))


def tag_requests(spark: SparkSession, resources: DataFrame) -> DataFrame:
    """Every inventoried resource, plus an unknown id of each type and an unknown type."""
    unknown = [("cluster", "missing"), ("warehouse", "missing"), ("job", "missing"), ("pipeline", "missing"), ("dashboard", "1")]
    extra = spark.createDataFrame(unknown, schemas.TAG_REQUESTS)
    return resources.select("resource_type", "resource_id").unionByName(extra)


TABLES = {"usage": usage, "list_prices": list_prices, "jobs": jobs, "job_run_timeline": job_run_timeline,
          "served_entities": served_entities, "clusters": clusters, "warehouses": warehouses,
          "job_settings": job_settings, "pipelines": pipelines}


class Tables(dict):
    """Fixture tables of one folder; each is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = TABLES[name](self.spark, self.sf_dir)
        return self[name]


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All fixture tables for one scale-factor folder."""
    tables = Tables(spark, sf_dir)
    return {name: tables[name] for name in TABLES}
