"""Benchmark the cost views and reports.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Input tables are derived from the test data once and written as Parquet
(``usage`` partitioned by ``usage_date``, as a billing table is stored); that
preparation is not timed.  Each query then runs against the stored tables and
is fully executed with a ``noop`` write; the reported time per query is the
median of ``BENCH_REPEATS`` runs after one warm-up.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from costlens.plans import dashboard as K  # noqa: E402
from costlens.plans import jobs as J  # noqa: E402
from costlens.plans import tagging as L  # noqa: E402
from costlens.plans.refresh import VIEWS, refresh_all  # noqa: E402
from costlens.session import build_session  # noqa: E402
from costlens.sources import fixtures  # noqa: E402
from costlens.suite.queries import AS_OF  # noqa: E402


def _prepare(spark, sf_dir: str, work: str) -> dict:
    raw = fixtures.load_all(spark, sf_dir)
    paths = {}
    for name, df in raw.items():
        path = f"{work}/tables/{name}"
        writer = df.write.mode("overwrite")
        if name == "usage":
            writer = writer.partitionBy("usage_date")
        writer.parquet(path)
        paths[name] = path
    return {n: spark.read.parquet(p) for n, p in paths.items()}


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    work = tempfile.mkdtemp(prefix="costlens-bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.sql.warehouse.dir": f"{work}/warehouse",
                                 "spark.driver.memory": "8g"})
    t = _prepare(spark, sf_dir, work)
    resources = L.resource_inventory(t["clusters"], t["warehouses"], t["job_settings"], t["pipelines"])

    queries = {name: (lambda fn=fn: fn(t, AS_OF)) for name, fn in VIEWS.items()}
    queries.update({
        "f4_status_cost_attribution": lambda: J.status_costs(t["usage"], t["list_prices"], t["job_run_timeline"], AS_OF),
        "k3_top_jobs_by_cost": lambda: K.top_jobs_by_cost(VIEWS["most_expensive_jobs"](t, AS_OF)),
        "k9_trend_cards": lambda: K.trend_cards(K.daily_job_costs(t["usage"], t["list_prices"], AS_OF)),
        "k17_unpack_tags": lambda: K.unpack_tags(VIEWS["serverless_consumption_by_tag"](t, AS_OF)),
        "l6_compliance_details": lambda: L.compliance_details(resources),
        "l7_compliance_by_type": lambda: L.compliance_by_type(resources),
        "l8_compliance_summary": lambda: L.compliance_summary(resources),
    })

    times = {}
    for name, build in queries.items():
        _run(build())  # warm-up
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            _run(build())
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)

    spark.sql("CREATE DATABASE IF NOT EXISTS costlens_bench")
    runs = []
    for _ in range(max(1, repeats)):
        t0 = time.perf_counter()
        refresh_all(spark, t, AS_OF, database="costlens_bench")
        runs.append(time.perf_counter() - t0)
    times["refresh_all"] = round(statistics.median(runs), 3)

    total = round(sum(v for k, v in times.items() if k != "refresh_all"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_medians", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
