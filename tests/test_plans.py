"""Physical-plan checks: broadcasts, pushdown, top-k and the bounded single-partition step."""

import datetime as dt
import re

import pytest

from conftest import SF_SMALL
from costlens.plans import dashboard as K
from costlens.plans import jobs as J
from costlens.plans.refresh import refresh_all
from costlens.sources import catalog, fixtures

AS_OF = dt.date(2024, 1, 31)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Fixture tables written as Parquet (usage partitioned by date), as they would be stored."""
    root = tmp_path_factory.mktemp("tables")
    out = {}
    for name, df in fixtures.load_all(spark, SF_SMALL).items():
        w = df.write.mode("overwrite")
        (w.partitionBy("usage_date") if name == "usage" else w).parquet(str(root / name))
        out[name] = spark.read.parquet(str(root / name))
    return out


def test_price_join_is_broadcast_and_filters_reach_the_scan(stored):
    t = stored
    p = plan(J.most_expensive_jobs(t["usage"], t["list_prices"], t["jobs"], AS_OF))
    assert "BroadcastHashJoin" in p
    assert re.search(r"PartitionFilters: \[[^\]]*usage_date", p)
    assert re.search(r"PushedFilters: \[[^\]]*billing_origin_product", p)


def test_scan_reads_only_needed_columns(spark, stored):
    t = stored
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        p = plan(J.job_spend_trend(t["usage"], t["list_prices"], t["jobs"], AS_OF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    schemas = re.findall(r"ReadSchema: (struct<\S*)", p)
    usage_schema = [s for s in schemas if "usage_quantity" in s][0]
    assert "usage_metadata:struct<job_id:string>" in usage_schema          # nested fields pruned
    assert "product_features" not in usage_schema and "account_id" not in usage_schema
    price_schema = [s for s in schemas if "price_start_time" in s][0]
    assert "pricing:struct<effective_list:struct<default:decimal(18,4)>>" in price_schema


def test_top_k_is_take_ordered(stored):
    t = stored
    p = plan(K.top_jobs_by_cost(J.most_expensive_jobs(t["usage"], t["list_prices"], t["jobs"], AS_OF)))
    assert "TakeOrderedAndProject" in p


def test_only_the_slice_summary_goes_to_a_single_partition(stored):
    t = stored
    df = J.status_costs(t["usage"], t["list_prices"], t["job_run_timeline"], AS_OF)
    p = plan(df)
    # exactly one single-partition exchange, fed by the per-slice aggregate
    assert p.count("SinglePartition") == 1
    single = p[:p.index("SinglePartition")]
    assert "Window" not in single.splitlines()[-1]


def test_refresh_writes_every_view_and_catalog_reads(spark, stored):
    spark.sql("CREATE DATABASE IF NOT EXISTS costlens_test")
    written = refresh_all(spark, stored, AS_OF, database="costlens_test")
    assert len(written) == 14
    names = {r.name for r in catalog.list_views(spark, "costlens_test").collect()}
    assert {"most_expensive_jobs", "job_retry_patterns", "model_serving_costs"} <= names
    cols = {r.column_name: r.data_type for r in catalog.describe_view(spark, "costlens_test.most_expensive_jobs").collect()}
    assert cols["custom_tags"] == "map<string,string>" and cols["runs"] == "bigint"
    capped = catalog.read_view(spark, "costlens_test.most_expensive_jobs", {"workspace_id": ["1"], "name": []}, limit=3,
                               order=["job_id"])
    rows = capped.collect()
    assert len(rows) <= 3 and all(r.workspace_id == "1" for r in rows)
    assert catalog.read_view(spark, "costlens_test.most_expensive_jobs").count() == \
        spark.table("costlens_test.most_expensive_jobs").count()
    with pytest.raises(ValueError):
        catalog.read_view(spark, "costlens_test.most_expensive_jobs", {"worksapce_id": "1"})
    with pytest.raises(ValueError):
        catalog.read_view(spark, "costlens_test.most_expensive_jobs", limit=3)
    from costlens.plans.refresh import VIEWS
    from costlens.suite.portable import portable
    for name in ["most_expensive_jobs", "most_expensive_job_runs", "failed_jobs_analysis", "job_retry_patterns"]:
        stored_rows = sorted(map(tuple, portable(spark.table(f"costlens_test.{name}")).collect()), key=repr)
        direct_rows = sorted(map(tuple, portable(VIEWS[name](stored, AS_OF)).collect()), key=repr)
        assert stored_rows == direct_rows, name


def test_refresh_with_shared_usage_window_sequentially(spark, stored):
    from costlens.plans.refresh import VIEWS
    from costlens.suite.portable import portable
    spark.sql("CREATE DATABASE IF NOT EXISTS costlens_test2")
    names = ["workspace_spend_alerts", "serverless_consumption_by_tag", "failed_jobs_analysis"]
    refresh_all(spark, stored, AS_OF, database="costlens_test2", views=names, share_usage_window=True,
                concurrent_views=1)
    for name in names:
        got = sorted(map(tuple, portable(spark.table(f"costlens_test2.{name}")).collect()), key=repr)
        want = sorted(map(tuple, portable(VIEWS[name](stored, AS_OF)).collect()), key=repr)
        assert got == want, name


def test_a_view_switches_only_after_its_write(spark):
    from pyspark.sql import functions as F
    from costlens.plans.refresh import materialize
    spark.sql("CREATE DATABASE IF NOT EXISTS costlens_swap")
    name = "costlens_swap.v"
    materialize(spark.range(3), name)
    reader = spark.table(name)                                            # begun before the next refresh
    with pytest.raises(Exception):
        materialize(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), name)
    assert spark.table(name).count() == 3
    materialize(spark.range(5), name)
    assert spark.table(name).count() == 5 and reader.count() == 3
    materialize(spark.range(7), name)
    materialize(spark.range(9), name)
    assert spark.table(name).count() == 9
    assert spark.sql("SHOW TABLES IN costlens_swap LIKE 'v__v*'").count() == 2


def test_status_costs_are_read_from_the_stored_rows(spark, stored):
    plan = J.status_costs(stored["usage"], stored["list_prices"], stored["job_run_timeline"], AS_OF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in text                                          # terminal and last rows are stored


def test_command_line_refresh(spark, tmp_path, capsys):
    from costlens.__main__ import main
    paths = {}
    for name, df in fixtures.load_all(spark, SF_SMALL).items():
        if name in ("usage", "list_prices", "jobs", "job_run_timeline", "served_entities"):
            paths[name] = str(tmp_path / name)
            df.write.mode("overwrite").parquet(paths[name])
    assert main(["refresh", "--database", "costlens_cli", "--as-of", "2024-01-31",
                 "--views", "most_expensive_jobs", "job_retry_patterns",
                 "--usage", paths["usage"], "--list-prices", paths["list_prices"], "--jobs", paths["jobs"],
                 "--job-run-timeline", paths["job_run_timeline"],
                 "--served-entities", paths["served_entities"]]) == 0
    assert "costlens_cli.most_expensive_jobs" in capsys.readouterr().out
    assert spark.table("costlens_cli.job_retry_patterns").count() > 0


def test_all_option_lists_of_a_page_read_usage_once(stored):
    """The lists of a page come from one evaluation of the view, equal triples merged before the shuffle."""
    view = J.most_expensive_jobs(stored["usage"], stored["list_prices"], stored["jobs"], AS_OF)
    cols = ["run_as", "name", "job_id"]
    options = K.page_options(view, cols)
    text = plan(options)
    assert len(re.findall(r"PartitionFilters: \[[^\]]*usage_date", text)) == 1
    assert re.search(r"HashAggregate\(keys=\[list_name[^\n]*\n[^\n]*Exchange hashpartitioning\(list_name", text)
    got = {}
    for r in options.collect():
        got.setdefault((r.list_name, r.tag_key), []).append(r.value)
    for c in cols:
        assert got.pop((c, None)) == [str(r[0]) for r in K.filter_options(view, c).collect()]
    keys = [r[0] for r in K.tag_keys(view).collect()]
    assert got.pop(("tag_key", None)) == keys
    assert got == {("tag_value", k): [r[0] for r in K.tag_values(view, k).collect()] for k in keys}


def test_command_line_refresh_by_day(spark, stored, tmp_path, capsys):
    from costlens.__main__ import main
    paths = {}
    for name in ("usage", "list_prices", "jobs", "job_run_timeline", "served_entities"):
        paths[name] = str(tmp_path / name)
        stored[name].write.mode("overwrite").parquet(paths[name])
    args = [f"--{n.replace('_', '-')}={p}" for n, p in paths.items()]
    for changed in ([], ["--changed", "2024-01-30", "2024-01-29", "--new-slices", paths["job_run_timeline"]]):
        assert main(["refresh", "--database", "costlens_days", "--as-of", "2024-01-31", "--views", "user_spend_alerts",
                     "most_expensive_jobs", "job_retry_patterns", "--by-day", *changed, *args]) == 0
        assert "costlens_days.user_spend_alerts" in capsys.readouterr().out
    assert spark.table("costlens_days.user_spend_alerts").count() > 0
    assert spark.table("costlens_days.most_expensive_jobs").count() > 0
    retries = J.job_retry_patterns(stored["usage"], stored["list_prices"], stored["job_run_timeline"], stored["jobs"], AS_OF)
    assert spark.table("costlens_days.job_retry_patterns").count() == retries.count() > 0
