"""Hand-made rows for the semantics the fixture tables do not reach."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import price_row, prices_df, ts, usage_df, usage_row
from costlens.operators.latest import latest_jobs
from costlens.operators.pricing import CONTAINMENT, POINT, priced_usage
from costlens.plans import jobs as J
from costlens.plans import serverless as S
from costlens.plans import serving as V

AS_OF = dt.date(2024, 1, 31)


def _prices(spark):
    return prices_df(spark, [price_row("SKU_A", "2023-01-01 00:00:00", "2024-01-15 12:30:00", "1.0", "0.5"),
                             price_row("SKU_A", "2024-01-15 12:30:00", None, "2.0", "1.0")])


def test_price_boundary_containment_drops_point_keeps(spark):
    u = usage_df(spark, [usage_row(1, "2024-01-15 12:00:00"),     # straddles 12:30
                         usage_row(2, "2024-01-15 13:00:00"),     # open-ended second price
                         usage_row(3, "2024-01-10 05:00:00")])
    p = _prices(spark)
    c = {r.record_id: r.list_cost for r in priced_usage(u, p, CONTAINMENT).collect()}
    assert c == {2: Decimal("2.000000"), 3: Decimal("1.000000")}
    pt = {r.record_id: r.list_cost for r in priced_usage(u, p, POINT).collect()}
    assert pt == {1: Decimal("1.000000"), 2: Decimal("2.000000"), 3: Decimal("1.000000")}


def test_containment_fans_out_over_accounts(spark):
    u = usage_df(spark, [usage_row(1, "2024-01-10 05:00:00")])
    p = prices_df(spark, [price_row("SKU_A", "2023-01-01 00:00:00", None, "1.0", "0.5", account="a1"),
                          price_row("SKU_A", "2023-01-01 00:00:00", None, "3.0", "0.5", account="a2")])
    assert priced_usage(u, p, CONTAINMENT).count() == 2
    assert priced_usage(u, p, POINT).count() == 1


def test_job_spend_trend_midnight_of_d_minus_8_counts_in_both_weeks(spark):
    # usage ending exactly at midnight of D-8 (2024-01-23 00:00) starts at 23:00 on D-9
    u = usage_df(spark, [usage_row(1, "2024-01-22 23:00:00", qty="1.00"),
                         usage_row(2, "2024-01-30 05:00:00", qty="2.00")])   # ends after midnight of D-1: neither
    p = prices_df(spark, [price_row("SKU_A", "2023-01-01 00:00:00", None, "1.0", "1.0")])
    jobs = spark.createDataFrame([("w1", "j1", "job one", ts("2024-01-01 00:00:00"))],
                                 "workspace_id string, job_id string, name string, change_time timestamp")
    r = J.job_spend_trend(u, p, jobs, AS_OF).collect()
    assert len(r) == 1
    assert r[0].Last7DaySpend == Decimal("1.000000") and r[0].Last14DaySpend == Decimal("1.000000")
    assert r[0].Last7DayGrowth == 0 and r[0].Last7DayGrowthPct == 0.0


def test_previous_week_is_exclusive_for_alerts_and_cumulative_for_serving(spark):
    rows = [usage_row(1, "2024-01-29 01:00:00", sku="X_SERVERLESS_Y", qty="1.00"),   # within 7 days
            usage_row(2, "2024-01-20 01:00:00", sku="X_SERVERLESS_Y", qty="10.00")]  # 8-14 days back
    p = prices_df(spark, [price_row("X_SERVERLESS_Y", "2023-01-01 00:00:00", None, "1.0", "1.0")])
    a = S.workspace_spend_alerts(usage_df(spark, rows), p, AS_OF).collect()[0]
    assert (a.t7d_list_cost, a.t14d_list_cost) == (Decimal("1.000000"), Decimal("10.000000"))

    srows = [usage_row(1, "2024-01-29 01:00:00", sku="P_SERVERLESS_REAL_TIME_INFERENCE_Q", endpoint="ep", qty="1.00"),
             usage_row(2, "2024-01-20 01:00:00", sku="P_SERVERLESS_REAL_TIME_INFERENCE_Q", endpoint="ep",
                       qty="10.00")]
    sp = prices_df(spark, [price_row("P_SERVERLESS_REAL_TIME_INFERENCE_Q", "2023-01-01 00:00:00", None, "1.0", "1.0")])
    ents = spark.createDataFrame([("a1", "ep", "id", "me", f"m{i}", "CUSTOM_MODEL", None, None) for i in range(3)],
                                 "account_id string, endpoint_name string, endpoint_id string, created_by string, "
                                 "served_entity_name string, entity_type string, custom_model_config string, "
                                 "external_model_config string")
    out = V.model_serving_costs(usage_df(spark, srows), sp, ents, AS_OF).collect()
    assert len(out) == 3                                   # one row per served entity: cost counted 3 times
    assert {(r.t7d_list_cost, r.t14d_list_cost, r.total_list_cost) for r in out} == \
        {(Decimal("1.000000"), Decimal("11.000000"), Decimal("11.000000"))}


def test_null_user_is_kept_by_views(spark):
    rows = [usage_row(1, "2024-01-29 01:00:00", sku="S_SERVERLESS", run_as=None),
            usage_row(2, "2024-01-29 02:00:00", sku="S_SERVERLESS", run_as="u@x")]
    p = prices_df(spark, [price_row("S_SERVERLESS", "2023-01-01 00:00:00", None, "1.0", "1.0")])
    users = {r.run_as for r in S.user_spend_alerts(usage_df(spark, rows), p, AS_OF).collect()}
    assert users == {None, "u@x"}


def test_latest_job_version_breaks_ties_and_ignores_null_time(spark):
    jobs = spark.createDataFrame(
        [("w", "1", "old", ts("2024-01-01 00:00:00")), ("w", "1", "new", ts("2024-01-05 00:00:00")),
         ("w", "1", "undated", None), ("w", "2", "b", ts("2024-01-02 00:00:00")),
         ("w", "2", "a", ts("2024-01-02 00:00:00"))],
        "workspace_id string, job_id string, name string, change_time timestamp")
    got = {r.job_id: r.name for r in latest_jobs(jobs).collect()}
    assert got == {"1": "new", "2": "b"}


def test_retry_never_succeeded_has_null_repair_time(spark):
    timeline = spark.createDataFrame(
        [(1, "w1", "j1", "r1", ts("2024-01-10 01:00:00"), ts("2024-01-10 01:20:00"), "FAILED"),
         (2, "w1", "j1", "r1", ts("2024-01-10 02:00:00"), ts("2024-01-10 02:20:00"), "FAILED"),
         (3, "w1", "j1", "r2", ts("2024-01-10 01:00:00"), ts("2024-01-10 01:20:00"), "FAILED"),
         (4, "w1", "j1", "r2", ts("2024-01-10 03:00:00"), ts("2024-01-10 03:20:30"), "SUCCEEDED")],
        "slice_id long, workspace_id string, job_id string, run_id string, period_start_time timestamp, "
        "period_end_time timestamp, result_state string")
    u = usage_df(spark, [usage_row(1, "2024-01-10 01:00:00", run_id="r1", sku="SKU_A")])
    p = _prices(spark)
    jobs = spark.createDataFrame([], "workspace_id string, job_id string, name string, change_time timestamp")
    got = {r.run_id: (r.repairs, r.repair_time_seconds)
           for r in J.job_retry_patterns(u, p, timeline, jobs, AS_OF).collect()}
    assert got == {"r1": (1, None), "r2": (1, 2 * 3600 + 30)}


def test_j1_and_j2_totals_agree(spark):
    from costlens.sources import fixtures
    from conftest import SF_SMALL
    t = fixtures.load_all(spark, SF_SMALL)
    j1 = J.most_expensive_jobs(t["usage"], t["list_prices"], t["jobs"], AS_OF).agg(F.sum("list_cost")).first()[0]
    j2 = J.most_expensive_job_runs(t["usage"], t["list_prices"], t["jobs"], AS_OF).agg(F.sum("list_cost")).first()[0]
    assert j1 == j2 and j1 > 0


def _without_broadcast(spark, build):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shuffled_price_join_equals_broadcast_join(spark):
    from conftest import SF_MID
    from costlens.sources import fixtures
    t = fixtures.load_all(spark, SF_MID)
    for mode in (CONTAINMENT, POINT):
        def rows():
            return sorted(priced_usage(t["usage"], t["list_prices"], mode).select(
                "record_id", "price_start_time", "list_cost", "effective_cost").collect())
        assert rows() == _without_broadcast(spark, rows)


def test_price_join_on_malformed_and_open_rows(spark):
    rows = [usage_row(1, "2024-01-15 12:00:00"),                      # straddles the change: no match
            usage_row(2, "2024-01-15 13:00:00", hours=-3),            # ends before it starts
            usage_row(3, "2024-01-20 05:00:00", hours=0),
            usage_row(4, "2024-01-10 23:00:00", hours=2)]             # crosses midnight
    u = usage_df(spark, rows)
    p = _prices(spark)
    for mode in (CONTAINMENT, POINT):
        def priced():
            return sorted((r.record_id, r.list_cost) for r in priced_usage(u, p, mode).collect())
        assert priced() == _without_broadcast(spark, priced)


def test_repairs_need_all_run_keys(spark):
    from conftest import ts
    schema = ("slice_id long, workspace_id string, job_id string, run_id string, period_start_time timestamp, "
              "period_end_time timestamp, result_state string")
    rows = [(i, ws, job, run, ts("2024-01-20 10:00:00"), ts(f"2024-01-20 1{i % 9}:30:00"), "FAILED")
            for i, (ws, job, run) in enumerate([("w1", "j1", "r1"), ("w1", "j1", "r1"), (None, "j1", "r2"), (None, "j1", "r2"),
                                                ("w1", None, "r3"), ("w1", None, "r3"), ("w1", "j1", None), ("w1", "j1", None)])]
    jobs = spark.createDataFrame([], "workspace_id string, job_id string, name string, change_time timestamp")
    u = usage_df(spark, [usage_row(1, "2024-01-20 10:00:00")])
    got = J.job_retry_patterns(u, _prices(spark), spark.createDataFrame(rows, schema), jobs, AS_OF).collect()
    assert [r.run_id for r in got] == ["r1"]

