"""Command line: refresh the cost views, e.g. from a scheduler.

    python -m costlens refresh --database finops --as-of 2024-01-31 \
        --usage catalog.billing.usage --list-prices catalog.billing.list_prices \
        --jobs catalog.jobs.jobs --job-run-timeline catalog.jobs.job_run_timeline \
        --served-entities catalog.serving.served_entities

Each input is a catalog table name or a Parquet path.  Runs in the session the
launcher provides (``spark-submit -m``/``python -m`` with the cluster's
configuration); ``--master`` is only for local runs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from .plans.daily import refresh_by_day
from .plans.refresh import VIEWS, refresh_all
from .sources import tables


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="costlens")
    sub = ap.add_subparsers(dest="command", required=True)
    r = sub.add_parser("refresh", help="rebuild the cost views as tables")
    r.add_argument("--database", required=True)
    r.add_argument("--as-of", default=None, help="report date YYYY-MM-DD (default: today)")
    r.add_argument("--views", nargs="*", default=None, choices=sorted(VIEWS))
    r.add_argument("--concurrent-views", type=int, default=4)
    r.add_argument("--by-day", action="store_true", help="assemble J6-J12 and J14 from stored sums of days")
    r.add_argument("--changed", nargs="*", default=[], type=dt.date.fromisoformat, help="with --by-day: days to sum again")
    r.add_argument("--new-slices", default=None, help="with --by-day: timeline slices since the last refresh, for J5's stored totals")
    for name in ("usage", "list-prices", "jobs", "job-run-timeline", "served-entities"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from .session import DEFAULT_CONF, ensure_checkpoint_dir
    builder = SparkSession.builder.appName("costlens-refresh")
    if a.master:
        builder = builder.master(a.master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {a.database}")
    inputs = {
        "usage": tables.usage(spark, a.usage),
        "list_prices": tables.list_prices(spark, a.list_prices),
        "jobs": tables.jobs(spark, a.jobs),
        "job_run_timeline": tables.job_run_timeline(spark, a.job_run_timeline),
        "served_entities": tables.served_entities(spark, a.served_entities),
    }
    as_of = dt.date.fromisoformat(a.as_of) if a.as_of else None
    if a.by_day:
        new_slices = tables.job_run_timeline(spark, a.new_slices) if a.new_slices else None
        written = refresh_by_day(spark, inputs, as_of, database=a.database, changed=a.changed, views=a.views,
                                 new_slices=new_slices)
    else:
        written = refresh_all(spark, inputs, as_of, database=a.database, views=a.views,
                              concurrent_views=a.concurrent_views)
    print(json.dumps({"written": written}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
