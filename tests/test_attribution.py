"""Status cost attribution (F4): parallel prefix scan vs the literal global scan."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from costlens.operators.attribution import (attribute_in_ranges, attribute_status_cost, attribution_bounds, slice_of,
                                            timeline_hour_join)
from pyspark.sql import functions as F
from conftest import usage_df, usage_row

ORDER = ["workspace_id", "job_id", "run_id", "usage_end_time", "record_id"]
SCHEMA = T.StructType([
    T.StructField("workspace_id", T.StringType()), T.StructField("job_id", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("usage_end_time", T.TimestampType()),
    T.StructField("record_id", T.LongType()), T.StructField("result_state", T.StringType()),
    T.StructField("list_cost", T.DecimalType(20, 6)), T.StructField("effective_cost", T.DecimalType(20, 6)),
])


def random_rows(seed, n):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        state = rng.choice([None, None, None, "FAILED", "SUCCEEDED", "TIMED_OUT"])
        cost = Decimal(rng.randint(-300, 1000)) / 100
        rows.append((rng.choice("ab"), str(rng.randint(1, 3)), str(rng.randint(1, 5)),
                     base + dt.timedelta(hours=rng.randint(0, 40)), i, state, cost, cost * 2))
    return rows


def brute_force(rows):
    """The original formulation: one running sum in global order, differenced on terminal rows."""
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    out, cum_l, cum_e, prev_l, prev_e = {}, Decimal(0), Decimal(0), Decimal(0), Decimal(0)
    for r in sorted(rows, key=key):
        cum_l += r[6]
        cum_e += r[7]
        if r[5] is not None:
            out[r[4]] = (cum_l - prev_l, cum_e - prev_e)
            prev_l, prev_e = cum_l, cum_e
    return out


def cuts(rows, slices):
    """Keys that cut the rows into about equal slices, fewer if keys repeat."""
    keys = sorted({r[:4] for r in rows})
    return [keys[i - 1] for i in sorted({len(keys) * i // slices for i in range(1, slices)} - {0})]


@pytest.mark.parametrize("seed,n,slices", [(1, 60, 1), (2, 60, 4), (3, 200, 7), (4, 200, 16), (5, 25, 40),
                                           (6, 300, 3)])
def test_parallel_scan_equals_global_scan(spark, seed, n, slices):
    rows = random_rows(seed, n)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["record_id"]: (r["status_list_cost"], r["status_effective_cost"])
           for r in attribute_status_cost(df, ORDER, cuts(rows, slices)).collect()}
    assert got == brute_force(rows)


def test_unterminated_tail_is_carried_to_next_run(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("w", "j", "r1", t, 1, "FAILED", Decimal(1), Decimal(1)),
            ("w", "j", "r1", t + dt.timedelta(hours=1), 2, None, Decimal(10), Decimal(10)),   # tail of r1
            ("w", "j", "r2", t, 3, None, Decimal(100), Decimal(100)),
            ("w", "j", "r2", t + dt.timedelta(hours=1), 4, "SUCCEEDED", Decimal(1000), Decimal(1000)),
            ("w", "j", "r3", t, 5, None, Decimal(7), Decimal(7))]                             # never terminated
    df = spark.createDataFrame(rows, SCHEMA)
    for slices in (1, 2, 5):
        got = {r["record_id"]: r["status_list_cost"]
               for r in attribute_status_cost(df, ORDER, cuts(rows, slices)).collect()}
        assert got == {1: Decimal(1), 4: Decimal(1110)}


def test_hour_join_matches_range_condition_and_keeps_fanout(spark):
    from conftest import ts
    usage = usage_df(spark, [usage_row(1, "2024-01-01 10:00:00", run_id="r1"),
                             usage_row(2, "2024-01-01 12:00:00", run_id="r1"),
                             usage_row(3, "2024-01-01 13:00:00", run_id="r1")])
    timeline = spark.createDataFrame(
        [(10, "w1", "j1", "r1", ts("2024-01-01 10:15:00"), ts("2024-01-01 10:35:00"), None),
         (11, "w1", "j1", "r1", ts("2024-01-01 10:40:00"), ts("2024-01-01 12:05:00"), "FAILED"),
         (12, "w1", "j1", "r1", ts("2024-01-01 14:00:00"), ts("2024-01-01 13:00:00"), None)],  # ends before start
        "slice_id long, workspace_id string, job_id string, run_id string, period_start_time timestamp, "
        "period_end_time timestamp, result_state string")
    pairs = sorted((r.record_id, r.slice_id) for r in timeline_hour_join(usage, timeline).collect())
    # record 1 (10h) meets both slices touching hour 10; record 2 (12h) only slice 11; 13h none
    assert pairs == [(1, 10), (1, 11), (2, 11)]


def test_bounds_come_from_the_usage_keys(spark):
    rows = [usage_row(i, f"2024-01-{1 + i % 20:02d} {i % 24:02d}:00:00", job_id=f"j{i % 3}", run_id=f"r{i % 7}")
            for i in range(200)]
    bounds = attribution_bounds(usage_df(spark, rows), num_slices=5)
    assert len(bounds.cuts) == 4 and bounds.cuts == sorted(bounds.cuts)
    assert bounds.span == (min(r[8] for r in rows), max(r[8] for r in rows))
    assert attribution_bounds(usage_df(spark, rows)).cuts == []        # few rows: one slice
    assert attribution_bounds(usage_df(spark, [])) == ((None, None), [], [])


def test_one_slice_without_cuts(spark):
    rows = random_rows(11, 400)
    got = {r["record_id"]: (r["status_list_cost"], r["status_effective_cost"])
           for r in attribute_status_cost(spark.createDataFrame(rows, SCHEMA), ORDER).collect()}
    assert got == brute_force(rows)


def test_null_keys_sort_first(spark):
    rows = [(None if i % 5 == 0 else r[0], *r[1:]) for i, r in enumerate(random_rows(31, 120))]
    key = lambda r: [(x is not None, x) for x in r[:4]]
    keys = sorted({r[:4] for r in rows}, key=key)
    got = {r["record_id"]: r["status_list_cost"]
           for r in attribute_status_cost(spark.createDataFrame(rows, SCHEMA), ORDER, keys[10::20]).collect()}
    want = brute_force([(r[0] or "", *r[1:]) for r in rows])
    assert got == {k: v[0] for k, v in want.items()}


def test_hot_run_with_a_third_of_all_rows(spark):
    rows = random_rows(21, 300)
    hot = [("a", "1", "1") + r[3:] for r in rows[:100]]       # one run holds a third of the rows
    rows = hot + rows[100:]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["record_id"]: (r["status_list_cost"], r["status_effective_cost"])
           for r in attribute_status_cost(df, ORDER, cuts(rows, 8)).collect()}
    assert got == brute_force(rows)


def test_long_slice_expands_only_inside_usage_span(spark):
    from conftest import ts
    usage = usage_df(spark, [usage_row(1, "2024-01-20 10:00:00", run_id="r1"),
                             usage_row(2, "2024-01-20 11:00:00", run_id="r1")])
    timeline = spark.createDataFrame(
        [(1, "w1", "j1", "r1", ts("2023-01-01 00:00:00"), ts("2024-06-01 00:00:00"), "FAILED"),   # 17 months
         (2, "w1", "j1", "r1", ts("2020-01-01 00:00:00"), ts("2020-01-02 00:00:00"), "FAILED")],  # long before
        "slice_id long, workspace_id string, job_id string, run_id string, period_start_time timestamp, "
        "period_end_time timestamp, result_state string")
    pairs = sorted((r.record_id, r.slice_id) for r in timeline_hour_join(usage, timeline).collect())
    assert pairs == [(1, 1), (2, 1)]


def test_given_span_equals_the_scanned_one(spark):
    from conftest import ts
    usage = usage_df(spark, [usage_row(1, "2024-01-01 10:00:00", run_id="r1")])
    timeline = spark.createDataFrame(
        [(10, "w1", "j1", "r1", ts("2024-01-01 10:15:00"), ts("2024-01-01 10:35:00"), None)],
        "slice_id long, workspace_id string, job_id string, run_id string, period_start_time timestamp, "
        "period_end_time timestamp, result_state string")
    span = attribution_bounds(usage).span
    for joined in (timeline_hour_join(usage, timeline), timeline_hour_join(usage, timeline, span)):
        assert [r.slice_id for r in joined.collect()] == [10]


def test_one_run_with_half_of_all_rows_is_cut_below_twice_the_bound(spark):
    """Slices follow the number of rows, and one task holds one slice."""
    rows = [usage_row(i, f"2024-01-{1 + i % 28:02d} {i // 28 % 24:02d}:00:00", job_id="hot" if i % 2 else f"j{i % 9}",
                      run_id="r1" if i % 2 else f"r{i % 31}") for i in range(6000)]
    usage = usage_df(spark, rows)
    bounds = attribution_bounds(usage, slice_rows=300)
    assert len(bounds.cuts) == 20 and not bounds.ranges
    keyed = usage.select("workspace_id", F.col("usage_metadata.job_id").alias("job_id"),
                         F.col("usage_metadata.job_run_id").alias("run_id"), "usage_end_time")
    order = ["workspace_id", "job_id", "run_id", "usage_end_time"]
    dealt = keyed.withColumn("s", slice_of(order, bounds.cuts)).repartitionById(21, F.col("s"))
    sizes = dealt.groupBy("s", F.spark_partition_id().alias("p")).count().collect()
    assert all(r["s"] == r["p"] for r in sizes) and len(sizes) == 21
    assert max(r["count"] for r in sizes) < 600 and sum(r["count"] for r in sizes) == 6000


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 100])
def test_slice_of_counts_the_cuts_below(spark, n):
    rows = random_rows(n, 150)
    keys = sorted({r[:4] for r in rows})[:n]
    got = {r["record_id"]: r["s"] for r in spark.createDataFrame(rows, SCHEMA).withColumn("s", slice_of(ORDER, keys)).collect()}
    assert got == {r[4]: sum(k < r[:4] for k in keys) for r in rows}


@pytest.mark.parametrize("seed,hot", [(41, False), (42, True)])
def test_ranges_equal_the_global_scan(spark, seed, hot):
    """More slices than a pass has: ranges, each sliced by its own sample."""
    rows = random_rows(seed, 240)
    if hot:
        rows = [("a", "1", "1") + r[3:] for r in rows[:120]] + rows[120:]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["record_id"]: (r["status_list_cost"], r["status_effective_cost"])
           for r in attribute_in_ranges(df, ORDER, cuts(rows, 4), slice_rows=20, pass_slices=3).collect()}
    assert got == brute_force(rows)
    assert set(attribute_in_ranges(df, ORDER, cuts(rows, 4), slice_rows=20).columns) == {*df.columns, "status_list_cost", "status_effective_cost"}


def test_bounds_of_a_large_window_are_ranges(spark):
    usage = usage_df(spark, [usage_row(i, f"2024-01-{1 + i % 20:02d} 05:00:00", run_id=f"r{i % 50}") for i in range(400)])
    bounds = attribution_bounds(usage, slice_rows=5, pass_slices=9)
    assert not bounds.cuts and len(bounds.ranges) == 8 and bounds.ranges == sorted(bounds.ranges)
