"""Status costs of crowded hours (J4, J5) without the product of records and slices."""

import datetime as dt

import pytest

from conftest import price_row, prices_df, ts, usage_df, usage_row
from costlens.plans import jobs as J
from costlens.sources import schemas

AS_OF = dt.date(2024, 1, 31)
RECORDS, STATES = 6, [None, "FAILED", None, "SUCCEEDED", "TIMED_OUT", "CANCELLED", None]


@pytest.fixture(scope="module")
def crowded(spark):
    """Three runs, each with several records and slices in one hour; records that are free, unpriced or end late."""
    rows, slices, n = [], [], 0
    for run in ("r1", "r2", "r3"):
        for k in range(RECORDS):
            n += 1
            rows.append(usage_row(n, "2024-01-10 10:00:00", run_id=run, qty=f"{n}.25", hours=1 + (k == 5), run_as=None if k == 0 else f"u{k}@x",
                                  tags=None if k == 1 else {"k": str(k)}, sku="SKU_B" if k == 4 else "SKU_A"))
        for k, state in enumerate(STATES):
            start = ts("2024-01-10 10:05:00") + dt.timedelta(minutes=k)
            slices.append((100 * n + k, "w1", "j1", run, start, start + dt.timedelta(minutes=5), state))
    rows.append(usage_row(99, "2024-01-10 11:00:00", run_id=None, qty="7.00"))
    prices = prices_df(spark, [price_row("SKU_A", "2023-01-01 00:00:00", None, "0.5000", "0.4000")])
    jobs = spark.createDataFrame([("w1", "j1", "job", ts("2024-01-01 00:00:00"))], schemas.JOBS)
    return usage_df(spark, rows), prices, spark.createDataFrame(slices, schemas.JOB_RUN_TIMELINE), jobs


@pytest.mark.parametrize("num_slices", [None, 3])
@pytest.mark.parametrize("view", [J.job_retry_patterns, J.failed_jobs_analysis])
def test_views_from_summed_usage_equal_those_from_every_record(crowded, view, num_slices):
    usage, prices, timeline, jobs = crowded
    every = J.status_costs(usage, prices, timeline, AS_OF, num_slices=num_slices)
    want = view(usage, prices, timeline, jobs, AS_OF, attributed=every)
    got = view(usage, prices, timeline, jobs, AS_OF, num_slices=num_slices)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_joined_rows_do_not_multiply_records_and_slices(crowded, monkeypatch):
    """An hour costs a row for each slice and usage end, however many records it has."""
    usage, prices, timeline, jobs = crowded
    seen, scan = [], J.attribute_status_cost

    def counted(rows, *args):
        seen.append(rows.count())
        return scan(rows, *args)

    monkeypatch.setattr(J, "attribute_status_cost", counted)
    J.job_retry_patterns(usage, prices, timeline, jobs, AS_OF)
    assert seen == [3 * 2 * len(STATES)]  # runs, usage ends and slices
