"""Materialising the cost views (B1), in presentation order (G1), and refreshing them together (B2)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import LOOKBACK_DAYS, TREND_LOOKBACK_DAYS
from ..functions.dates import days_before
from ..operators.latest import latest_jobs
from ..operators.picks import tags_order_key
from ..operators.ranks import positions, ranged
from ..session import ensure_checkpoint_dir
from . import jobs as J
from . import serverless as S
from . import serving as V

ViewFn = Callable[[dict, object], DataFrame]

# name -> builder(tables, as_of); tables holds usage, list_prices, jobs, job_run_timeline, served_entities
VIEWS: dict[str, ViewFn] = {
    "most_expensive_jobs": lambda t, d: J.most_expensive_jobs(t["usage"], t["list_prices"], t["jobs"], d,
                                                              runs=t.get("_run_costs")),
    "most_expensive_job_runs": lambda t, d: J.most_expensive_job_runs(t["usage"], t["list_prices"], t["jobs"], d,
                                                                      runs=t.get("_run_costs")),
    "job_spend_trend": lambda t, d: J.job_spend_trend(t["usage"], t["list_prices"], t["jobs"], d),
    "failed_jobs_analysis": lambda t, d: J.failed_jobs_analysis(t["usage"], t["list_prices"], t["job_run_timeline"],
                                                                t["jobs"], d, attributed=t.get("_status_costs")),
    "job_retry_patterns": lambda t, d: J.job_retry_patterns(t["usage"], t["list_prices"], t["job_run_timeline"],
                                                            t["jobs"], d, attributed=t.get("_status_costs"),
                                                            totals=t.get("_run_totals")),
    "workspace_spend_alerts": lambda t, d: S.workspace_spend_alerts(t["usage"], t["list_prices"], d),
    "user_spend_alerts": lambda t, d: S.user_spend_alerts(t["usage"], t["list_prices"], d),
    "job_spend_alerts": lambda t, d: S.job_spend_alerts(t["usage"], t["list_prices"], d),
    "serverless_notebook_spend": lambda t, d: S.serverless_notebook_spend(t["usage"], t["list_prices"], d),
    "serverless_job_spend": lambda t, d: S.serverless_job_spend(t["usage"], t["list_prices"], d),
    "user_serverless_consumption": lambda t, d: S.user_serverless_consumption(t["usage"], t["list_prices"], d),
    "serverless_consumption_by_tag": lambda t, d: S.serverless_consumption_by_tag(t["usage"], t["list_prices"], d),
    "model_serving_costs": lambda t, d: V.model_serving_costs(t["usage"], t["list_prices"], t["served_entities"], d),
    "batch_inference_costs": lambda t, d: V.batch_inference_costs(t["usage"], t["list_prices"], d),
}


#: Days of usage a view looks back, where it is not the common window.
VIEW_LOOKBACK = {"job_spend_trend": TREND_LOOKBACK_DAYS}

# G1: the order each view is presented in (metric descending), with its key columns as tie-breaks.
VIEW_ORDER: dict[str, tuple[str, list[str]]] = {
    "most_expensive_jobs": ("list_cost", ["workspace_id", "job_id"]),
    "most_expensive_job_runs": ("list_cost", ["workspace_id", "job_id", "run_id"]),
    "job_spend_trend": ("Last7DayGrowth", ["workspace_id", "job_id", "run_as", "sku_name", "custom_tags"]),
    "failed_jobs_analysis": ("failures", ["workspace_id", "job_id"]),
    "job_retry_patterns": ("repairs", ["workspace_id", "job_id", "run_id"]),
    "workspace_spend_alerts": ("effective_cost", ["workspace_id"]),
    "user_spend_alerts": ("effective_cost", ["run_as"]),
    "job_spend_alerts": ("effective_cost", ["workspace_id", "job_id"]),
    "serverless_notebook_spend": ("effective_cost", ["notebook_id", "notebook_path", "run_as"]),
    "serverless_job_spend": ("effective_cost", ["job_id", "job_name"]),
    "user_serverless_consumption": ("effective_cost", ["job_id", "job_name", "notebook_id", "notebook_path", "run_as"]),
    "serverless_consumption_by_tag": ("effective_cost", ["job_id", "job_name", "notebook_id", "notebook_path", "custom_tags"]),
    "model_serving_costs": ("total_effective_cost", ["workspace_id", *V.ENTITY_COLS]),
    "batch_inference_costs": ("total_effective_cost", ["workspace_id", "usage_date", "run_as", "endpoint_name", "custom_tags"]),
}


def view_order(name: str, df: DataFrame) -> list[Column]:
    """G1: the presentation order of a view as sort expressions."""
    metric, keys = VIEW_ORDER[name]
    types = dict(df.dtypes)
    by = [tags_order_key(k) if types[k].startswith("map") else F.col(k) for k in keys]
    return [F.col(metric).desc_nulls_last(), *[c.asc_nulls_first() for c in by]]


def sorted_view(name: str, df: DataFrame) -> DataFrame:
    """G1: a view in its presentation order."""
    return df.orderBy(*view_order(name, df))


def ranked_view(name: str, df: DataFrame) -> DataFrame:
    """G1: a view with the ``position`` of each row in its presentation order."""
    return positions(df, view_order(name, df))


JOB_NAME_VIEWS = ["most_expensive_jobs", "most_expensive_job_runs", "job_spend_trend", "failed_jobs_analysis",
                  "job_retry_patterns"]


class RefreshConflict(RuntimeError):
    """Another refresh committed a version of the view while this one was writing."""


class Version(NamedTuple):
    """A version of a view that is being written: its number, its table and the commit folder."""

    view: str
    number: int
    table: str
    commits: str


def _split(name: str) -> tuple[str, str]:
    database, _, view = name.rpartition(".")
    return database, view


def folder(spark: SparkSession, path: str):
    """File system and path object of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _last_commit(spark: SparkSession, commits: str) -> int:
    """Number of the last committed version, 0 without any."""
    fs, where = folder(spark, commits)
    return max((int(f.getPath().getName()) for f in fs.listStatus(where)), default=0) if fs.exists(where) else 0


def _committed_table(spark: SparkSession, commits: str, number: int) -> str:
    return spark.read.text(f"{commits}/{number}").first()[0]


def database_location(spark: SparkSession, database: str | None) -> str:
    """Folder of a database (none named: the current one)."""
    return spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri.rstrip("/")


def begin_version(spark: SparkSession, name: str) -> Version:
    """The version after the last committed one, to be written and then committed."""
    database, view = _split(name)
    commits = f"{database_location(spark, database)}/_commits/{view}"
    number = _last_commit(spark, commits) + 1
    table = f"{view}__v{number:09d}_{uuid.uuid4().hex}"
    return Version(name, number, f"{database}.{table}" if database else table, commits)


def commit_version(spark: SparkSession, version: Version) -> None:
    """Make a written version the view's: claim its number, switch the view, drop what is older than the version before.

    The claim is a file that only one writer can create, so of two refreshes that
    began from the same version the second is refused, whatever their order of
    writing; its table is dropped and :class:`RefreshConflict` raised.  After switching the view the
    writer looks whether a later version was committed meanwhile and switches
    to that, so the view ends on the last committed version.
    """
    fs, where = folder(spark, f"{version.commits}/{version.number}")
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if not fs.exists(where):
            raise
        spark.sql(f"DROP TABLE IF EXISTS {version.table}")
        raise RefreshConflict(f"{version.view}: version {version.number} was committed by another refresh") from error
    out.write(bytearray(version.table.encode()))
    out.close()
    number, table = version.number, version.table
    while True:
        spark.sql(f"CREATE OR REPLACE VIEW {version.view} AS SELECT * FROM {table}")
        last = _last_commit(spark, version.commits)
        if last == number:
            break
        number, table = last, _committed_table(spark, version.commits, last)
    database, view = _split(version.view)
    prefix = f"{database}." if database else ""
    listed = spark.sql(f"SHOW TABLES {'IN ' + database if database else ''} LIKE '{view}__v*'").collect()
    for old in sorted(r["tableName"] for r in listed):
        if int(old.rpartition("__v")[2].partition("_")[0]) < version.number - 1:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{old}")


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = (), order: Sequence[Column] = ()) -> str:
    """B1: ``CREATE OR REPLACE`` as a catalog view over a versioned table, in files ranged by ``order``.

    The result is written to a table of its own, and the view ``name`` is switched
    to it in one catalog change after the write succeeded.  Until then, and if
    the write fails, readers see the previous version; that version's table is
    only dropped by the refresh after the next, so a reader that began before the
    switch can finish.  A version that another refresh is writing is never dropped:
    its number is not below the last committed one (:func:`commit_version`).
    """
    spark = df.sparkSession
    version = begin_version(spark, name)
    writer = (ranged(df, order) if order else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(version.table)
    commit_version(spark, version)
    return name


def refresh_all(spark: SparkSession, tables: dict[str, DataFrame], as_of=None, database: str | None = None,
                views: Sequence[str] | None = None, share_usage_window: bool = False,
                concurrent_views: int = 4) -> list[str]:
    """B2: rebuild every view (or ``views``) as tables in ``database``.

    By default every view scans usage itself: partition pruning and column pruning
    keep each scan to the days and columns that view needs, which beats storing
    a month of usage at large scale.  ``share_usage_window=True`` writes the days of
    the longest look-back among the views once instead.  Intermediate results are
    computed once, written to the shared checkpoint folder and shared: the latest version of each job (J1-J5), the per-run costs
    behind J1 and J2 (one row per run), and the status cost attribution behind
    J4 and J5 (terminal run slices only).  Up to ``concurrent_views`` views are
    written at the same time as concurrent Spark jobs of this session.
    """
    t = dict(tables)
    names = list(views or VIEWS)
    ensure_checkpoint_dir(spark)
    if share_usage_window:
        days = max(VIEW_LOOKBACK.get(n, LOOKBACK_DAYS) for n in names)
        t["usage"] = t["usage"].where(F.col("usage_date") >= days_before(as_of, days)).checkpoint()
    if sum(n in names for n in JOB_NAME_VIEWS) > 1:
        # J1-J5 each need the latest version per job; reduce the history once (taking the
        # latest version again is a no-op on the result)
        t["jobs"] = latest_jobs(t["jobs"]).checkpoint()
    if {"most_expensive_jobs", "most_expensive_job_runs"} <= set(names):
        t["_run_costs"] = J.run_costs(t["usage"], t["list_prices"], as_of).checkpoint()
    if {"failed_jobs_analysis", "job_retry_patterns"} <= set(names):
        t["_status_costs"] = J.summed_status_costs(t["usage"], t["list_prices"], t["job_run_timeline"], as_of).checkpoint()

    def build(name: str) -> str:
        df = VIEWS[name](t, as_of)
        return materialize(df, f"{database}.{name}" if database else name, order=view_order(name, df))

    if concurrent_views > 1:
        # independent views are submitted as concurrent Spark jobs; the scheduler interleaves their stages
        with ThreadPoolExecutor(max_workers=concurrent_views) as pool:
            return list(pool.map(build, names))
    return [build(n) for n in names]
