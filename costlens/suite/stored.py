"""Registered queries that write given tables and read them back (A1-A5, A7-A9, B1, B2 also by day, G1, L4 in turn), with their SQL.

Tables are written once per application and data folder, under the shared
checkpoint folder; the database of the refreshed views lies there as well.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MERGE, REMOVE, REPLACE
from ..plans import daily, refresh, run_state
from ..plans import tagging as L
from ..plans.jobs import job_retry_patterns
from ..session import ensure_checkpoint_dir, use_utc
from ..sources import catalog, fixtures, tables
from .oracle import VIEWS, tags_txt, with_fixtures
from .portable import portable

AS_OF = dt.date(2024, 1, 31)

_WRITTEN: dict[tuple[str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str) -> str:
    return hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:16]


def given(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of a fixture table written as Parquet, ``usage`` by day as a billing table is."""
    use_utc(spark)
    key = (_key(spark, sf_dir), name)
    if key not in _WRITTEN:
        path = f"{ensure_checkpoint_dir(spark)}/given-{key[0]}/{name}"
        writer = fixtures.TABLES[name](spark, sf_dir).write.mode("overwrite")
        (writer.partitionBy("usage_date") if name == "usage" else writer).parquet(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def database(spark: SparkSession, sf_dir: str) -> str:
    """A database of this application and data folder, in the shared folder."""
    name = f"costlens_{_key(spark, sf_dir)}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{ensure_checkpoint_dir(spark)}/{name}.db'")
    return name


def a1_usage(spark, sf_dir):
    """A1: usage of the last days, read back from the table by day."""
    df = tables.usage(spark, given(spark, sf_dir, "usage")).where(F.col("usage_date") >= F.lit("2024-01-20").cast("date"))
    return portable(df.select("record_id", "account_id", "workspace_id", "cloud", "sku_name", "billing_origin_product", "usage_unit",
                              "usage_quantity", "usage_start_time", "usage_end_time", "usage_date", "custom_tags", "usage_metadata.*",
                              "identity_metadata.run_as", "product_features.is_serverless",
                              "product_features.model_serving.offering_type"))


def a2_list_prices(spark, sf_dir):
    """A2: the price history."""
    df = tables.list_prices(spark, given(spark, sf_dir, "list_prices"))
    return portable(df.select("account_id", "cloud", "sku_name", "usage_unit", "price_start_time", "price_end_time",
                              F.col("pricing.default").alias("list_default"),
                              F.col("pricing.effective_list.default").alias("effective_default")))


def a3_jobs(spark, sf_dir):
    """A3: all versions of the job definitions."""
    return tables.jobs(spark, given(spark, sf_dir, "jobs"))


def a4_job_run_timeline(spark, sf_dir):
    """A4: slices of job runs."""
    return tables.job_run_timeline(spark, given(spark, sf_dir, "job_run_timeline"))


def a5_served_entities(spark, sf_dir):
    """A5: served entities."""
    return tables.served_entities(spark, given(spark, sf_dir, "served_entities"))


def a9_resource_listings(spark, sf_dir):
    """The four resource listings, read back and put into one inventory."""
    names = ("clusters", "warehouses", "job_settings", "pipelines")
    return portable(L.resource_inventory(*(getattr(tables, n)(spark, given(spark, sf_dir, n)) for n in names)))


def _view_of(spark, sf_dir, name: str) -> DataFrame:
    return refresh.VIEWS[name](fixtures.Tables(spark, sf_dir), AS_OF)


def b1_materialize(spark, sf_dir):
    """B1: a view committed twice; the second version is what readers get."""
    use_utc(spark)
    name = f"{database(spark, sf_dir)}.spend_of_jobs"
    df = _view_of(spark, sf_dir, "most_expensive_jobs")
    refresh.materialize(df.where("runs > 3"), name)
    refresh.materialize(df, name, order=refresh.view_order("most_expensive_jobs", df))
    return portable(catalog.read_view(spark, name))


def _refreshed(spark, sf_dir) -> str:
    """The database with all views, refreshed once per application and data folder."""
    use_utc(spark)
    name, key = database(spark, sf_dir), (_key(spark, sf_dir), "refreshed")
    if key not in _WRITTEN:
        refresh.refresh_all(spark, fixtures.load_all(spark, sf_dir), AS_OF, name)
        _WRITTEN[key] = name
    return name


def b2_refresh_all(spark, sf_dir):
    """B2: rows and sum of the leading metric of every refreshed view."""
    name, out = _refreshed(spark, sf_dir), None
    for view, (metric, _) in refresh.VIEW_ORDER.items():
        part = spark.table(f"{name}.{view}").agg(F.lit(view).alias("view_name"), F.count("*").alias("n_rows"),
                                                 F.round(F.sum(F.col(metric).cast("double")), 3).alias("metric_sum"))
        part = part.select("view_name", "n_rows", "metric_sum")
        out = part if out is None else out.unionByName(part)
    return out


def a7_describe_view(spark, sf_dir):
    """Columns of a stored view, their types by kind."""
    found = catalog.describe_view(spark, f"{_refreshed(spark, sf_dir)}.most_expensive_jobs")
    return found.select("column_name", F.regexp_extract("data_type", "^[a-z]+", 0).alias("kind"))


def a8_list_views(spark, sf_dir):
    """The stored views that readers see (without the tables of their versions)."""
    found = catalog.list_views(spark, _refreshed(spark, sf_dir))
    return found.where((F.col("table_type") == "VIEW") & F.col("name").isin(*refresh.VIEWS)).select("name", "table_type")


def _g1(name: str):
    def run(spark, sf_dir):
        use_utc(spark)
        return portable(refresh.ranked_view(name, spark.table(f"{_refreshed(spark, sf_dir)}.{name}")))
    run.__doc__ = f"G1: the stored view {name} with the position of each row in its order."
    return run


CHANGES = [({"environment": "production", "reviewed": "2024"}, MERGE), ({"environment": "x"}, REMOVE), ({"team": "one"}, REPLACE)]


def l4_updates_in_turn(spark, sf_dir):
    """L4: merge, remove and replace in turn over all resources, each resource requested twice."""
    use_utc(spark)
    t = fixtures.Tables(spark, sf_dir)
    resources = L.resource_inventory(t["clusters"], t["warehouses"], t["job_settings"], t["pipelines"])
    requests = resources.select("resource_type", "resource_id")
    return portable(L.updates_in_turn(resources, requests.unionByName(requests), CHANGES))


#: Days that reach the stored sums late, and the report date of the first step.
LATE_DAYS = (dt.date(2024, 1, 9), dt.date(2024, 1, 17))
FIRST_STEP = dt.date(2024, 1, 22)


def _b2_daily(name: str):
    def run(spark, sf_dir):
        use_utc(spark)
        where, key = database(spark, sf_dir), (_key(spark, sf_dir), f"daily {name}")
        usage = tables.usage(spark, given(spark, sf_dir, "usage"))
        prices = tables.list_prices(spark, given(spark, sf_dir, "list_prices"))
        if key not in _WRITTEN:
            daily.advance_days(spark, name, usage.where(~F.col("usage_date").isin(*LATE_DAYS)), prices, FIRST_STEP, where)
            daily.advance_days(spark, name, usage, prices, AS_OF, where, LATE_DAYS)
            _WRITTEN[key] = where
        return portable(daily.from_days(spark, name, usage, prices, AS_OF, where))
    run.__doc__ = f"B2: the view {name} assembled from stored days, after a second step with two late days."
    return run


def b2_retries_from_state(spark, sf_dir):
    """B2: J5 from stored run totals after three deliveries, with a late day and slices delivered again."""
    use_utc(spark)
    where, key = database(spark, sf_dir), (_key(spark, sf_dir), "run totals")
    t = fixtures.Tables(spark, sf_dir)
    slices = tables.job_run_timeline(spark, given(spark, sf_dir, "job_run_timeline"))
    if key not in _WRITTEN:
        end = F.to_date("period_end_time")
        run_state.advance_runs(spark, slices.where((end < "2024-01-12") & (end != "2024-01-08")), where)
        run_state.advance_runs(spark, slices.where((end >= "2024-01-05") & (end < "2024-01-22")), where)
        run_state.advance_runs(spark, slices.where((end >= "2024-01-20") | end.isNull() | (end < "2024-01-03")), where)
        _WRITTEN[key] = where
    totals = run_state.stored_run_totals(spark, slices, where)
    return portable(job_retry_patterns(t["usage"], t["list_prices"], slices, t["jobs"], AS_OF, totals=totals))


STORED_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_usage": a1_usage, "a2_list_prices": a2_list_prices, "a3_jobs": a3_jobs, "a4_job_run_timeline": a4_job_run_timeline,
    "a5_served_entities": a5_served_entities, "a7_describe_view": a7_describe_view, "a8_list_views": a8_list_views,
    "a9_resource_listings": a9_resource_listings, "b1_materialize": b1_materialize, "b2_refresh_all": b2_refresh_all,
    **{f"g1_{name}": _g1(name) for name in refresh.VIEW_ORDER}, "l4_updates_in_turn": l4_updates_in_turn, "b2_retries_from_state": b2_retries_from_state,
    **{f"b2_daily_{name}": _b2_daily(name) for name in daily.DAILY_VIEWS},
}


def _ranked_sql(name: str) -> str:
    metric, keys = refresh.VIEW_ORDER[name]
    by = ", ".join([f"{metric} DESC NULLS LAST", *(f"{k} ASC NULLS FIRST" for k in keys)])
    return f"SELECT *, row_number() OVER (ORDER BY {by}) AS position FROM ({VIEWS[name]}) x"


def _in_turn_sql() -> str:
    without = ("map_from_entries(list_filter(map_entries({m}), lambda e: e.key NOT IN ({keys})))")
    merged = (f"map_concat({without.format(m='tags_map', keys=repr('environment') + ', ' + repr('reviewed'))}, "
              "MAP {'environment': 'production', 'reviewed': '2024'})")
    removed = without.format(m="t1", keys="'environment'")
    turns = [("t0", "t1", "merge", 1), ("t1", "t2", "remove", 2), ("t2", "t3", "replace", 3)]
    error = """CASE WHEN NOT taggable THEN CASE resource_type WHEN 'job' THEN 'Job ' WHEN 'pipeline' THEN 'Pipeline ' END || resource_id
      || ' not found' || CASE resource_type WHEN 'job' THEN ' or has no settings' ELSE ' or has no spec' END END"""
    rows = []
    for before, after, operation, turn in turns:
        for previous in (before, after):  # the second request finds what the first one left
            rows.append(f"""SELECT resource_type, resource_id, taggable AS success, CASE WHEN taggable THEN {tags_txt(previous)} END AS previous_tags,
  CASE WHEN taggable THEN {tags_txt(after)} END AS new_tags, CASE WHEN taggable THEN '{operation}' END AS operation, {error} AS error,
  {turn} AS turn FROM states""")
    return f"""SELECT * FROM (WITH one AS (SELECT *, tags_map AS t0, {merged} AS t1 FROM resources),
  states AS (SELECT *, {removed} AS t2, MAP {{'team': 'one'}} AS t3 FROM one)
{' UNION ALL '.join(rows)}) y"""


def stored_oracle_sql() -> dict[str, str]:
    kinds = [("name", "string"), ("job_id", "string"), ("workspace_id", "string"), ("runs", "bigint"), ("run_as", "string"),
             ("list_cost", "decimal"), ("effective_cost", "decimal"), ("custom_tags", "map"), ("last_seen_date", "timestamp")]
    bodies = {
        "a1_usage": """SELECT record_id, account_id, workspace_id, cloud, sku_name, billing_origin_product, usage_unit,
  CAST(usage_quantity AS DOUBLE) AS usage_quantity, usage_start_time, usage_end_time, usage_date, tags_txt AS custom_tags, job_id,
  job_run_id, job_name, notebook_id, notebook_path, endpoint_name, run_as, is_serverless, offering_type
FROM usage WHERE usage_date >= DATE '2024-01-20'""",
        "a2_list_prices": """SELECT account_id, cloud, sku_name, usage_unit, price_start_time, price_end_time,
  CAST(list_default AS DOUBLE) AS list_default, CAST(effective_default AS DOUBLE) AS effective_default FROM list_prices""",
        "a3_jobs": "SELECT workspace_id, job_id, name, change_time FROM jobs",
        "a4_job_run_timeline": """SELECT slice_id, workspace_id, job_id, run_id, period_start_time, period_end_time, result_state
FROM job_run_timeline""",
        "a5_served_entities": """SELECT account_id, endpoint_name, endpoint_id, created_by, served_entity_name, entity_type,
  custom_model_config, external_model_config FROM served_entities""",
        "a7_describe_view": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}')" for c, k in kinds) + ") v(column_name, kind)",
        "a8_list_views": "SELECT * FROM (VALUES " + ", ".join(f"('{v}', 'VIEW')" for v in VIEWS) + ") v(name, table_type)",
        "a9_resource_listings": """SELECT resource_type, resource_id, resource_name, state, tags_txt AS tags, cluster_size,
  creator_user_name, taggable, tag_count FROM resources""",
        "b1_materialize": VIEWS["most_expensive_jobs"],
        "b2_refresh_all": " UNION ALL ".join(
            f"SELECT '{v}' AS view_name, count(*) AS n_rows, round(sum(CAST({m} AS DOUBLE)), 3) AS metric_sum FROM ({VIEWS[v]}) x"
            for v, (m, _) in refresh.VIEW_ORDER.items()),
        **{f"g1_{name}": _ranked_sql(name) for name in refresh.VIEW_ORDER},
        "l4_updates_in_turn": _in_turn_sql(),
        "b2_retries_from_state": VIEWS["job_retry_patterns"],
        **{f"b2_daily_{name}": VIEWS[name] for name in daily.DAILY_VIEWS},
    }
    return {name: with_fixtures(body) for name, body in bodies.items()}
