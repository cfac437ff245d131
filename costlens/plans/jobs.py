"""Job cost views.

Every view takes the usage and price tables (plus jobs / run timeline where
needed) and an explicit report date ``as_of`` (``None`` = today), and returns an
unordered DataFrame; sorting is left to the reader (a stored view has no order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import FAILURE_STATES, LOOKBACK_DAYS, PRODUCT_JOBS, SUCCEEDED, TREND_LOOKBACK_DAYS
from ..functions.dates import as_date, days_before, growth_pct, hour_floor, midnight, seconds_between
from ..operators.attribution import (COSTS, Bounds, attribute_in_ranges, attribute_status_cost, attribution_bounds,
                                      attribution_order, timeline_hour_join)
from ..operators.latest import latest_jobs
from ..operators.picks import TAGS_KEY, sum_then_pick, with_tags_key
from ..operators.pricing import priced_usage

JOB_KEYS = ["workspace_id", "job_id"]
RUN_KEYS = ["workspace_id", "job_id", "run_id"]
STATUS_COSTS = ["status_list_cost", "status_effective_cost"]


def jobs_usage(usage: DataFrame, as_of, lookback_days: int) -> DataFrame:
    """Usage billed to jobs in the lookback window."""
    return usage.where((F.col("billing_origin_product") == PRODUCT_JOBS)
                       & (F.col("usage_date") >= days_before(as_of, lookback_days)))


def _job_columns(priced: DataFrame, *more: str) -> DataFrame:
    return with_tags_key(priced).select(
        "workspace_id",
        F.col("usage_metadata.job_id").alias("job_id"),
        F.col("usage_metadata.job_run_id").alias("run_id"),
        F.col("identity_metadata.run_as").alias("run_as"),
        "custom_tags", TAGS_KEY, "list_cost", "effective_cost", "usage_end_time", "sku_name", *more,
    )


def _job_names(jobs: DataFrame) -> DataFrame:
    return latest_jobs(jobs).select(*JOB_KEYS, "name")


def _run_level(cols: DataFrame) -> DataFrame:
    return sum_then_pick(cols, RUN_KEYS, ["list_cost", "effective_cost"], latest={"usage_end_time": "last_seen_date"})


def run_costs(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Per-run cost, user, tag pick and last usage over the window (shared by J1 and J2)."""
    return _run_level(_job_columns(priced_usage(jobs_usage(usage, as_of, lookback_days), prices)))


def most_expensive_jobs(usage: DataFrame, prices: DataFrame, jobs: DataFrame, as_of=None,
                        lookback_days: int = LOOKBACK_DAYS, runs: DataFrame | None = None) -> DataFrame:
    """Cost, distinct runs, user, tags and last usage per job over the window.

    Aggregated in two levels (per run, then per job) so a job with very many
    runs is combined across tasks instead of in one.  ``runs`` may pass a
    precomputed :func:`run_costs` (shared with J2 during a refresh).
    """
    if runs is None:
        runs = run_costs(usage, prices, as_of, lookback_days)
    per_job = sum_then_pick(runs.withColumn("runs", F.col("run_id").isNotNull().cast("long")), JOB_KEYS,
                            ["runs", "list_cost", "effective_cost"], latest={"last_seen_date": "last_seen_date"})
    return per_job.join(_job_names(jobs), JOB_KEYS, "left").select(
        "name", "job_id", "workspace_id", "runs", "run_as", "list_cost", "effective_cost",
        "custom_tags", "last_seen_date")


def most_expensive_job_runs(usage: DataFrame, prices: DataFrame, jobs: DataFrame, as_of=None,
                            lookback_days: int = LOOKBACK_DAYS, runs: DataFrame | None = None) -> DataFrame:
    """Cost, user, tags and last usage per job run over the window."""
    if runs is None:
        runs = run_costs(usage, prices, as_of, lookback_days)
    return runs.join(_job_names(jobs), JOB_KEYS, "left").select(
        "workspace_id", "name", "job_id", "run_id", "run_as", "list_cost", "effective_cost",
        "custom_tags", "last_seen_date")


def job_spend_trend(usage: DataFrame, prices: DataFrame, jobs: DataFrame, as_of=None,
                    lookback_days: int = TREND_LOOKBACK_DAYS) -> DataFrame:
    """Effective spend of the last week vs the week before, per job, user, SKU and tag set.

    Windows on ``usage_end_time``, both ends inclusive: last week
    ``[D-8, D-1]``, week before ``[D-15, D-8]`` (midnight of D-8 counts in both).
    """
    d = as_date(as_of)
    end = F.col("usage_end_time")
    last7 = end.between(midnight(F.date_sub(d, 8)), midnight(F.date_sub(d, 1)))
    prev7 = end.between(midnight(F.date_sub(d, 15)), midnight(F.date_sub(d, 8)))
    cols = _job_columns(priced_usage(jobs_usage(usage, as_of, lookback_days), prices))
    eff = F.col("effective_cost")
    agg = cols.groupBy("workspace_id", "job_id", "run_as", "sku_name", "custom_tags").agg(
        F.sum(F.when(last7, eff).otherwise(F.lit(0))).alias("Last7DaySpend"),
        F.sum(F.when(prev7, eff).otherwise(F.lit(0))).alias("Last14DaySpend"),
    )
    l7, l14 = F.col("Last7DaySpend"), F.col("Last14DaySpend")
    return agg.join(_job_names(jobs), JOB_KEYS, "left").select(
        "name", "workspace_id", "job_id", "sku_name", "run_as", "custom_tags", "Last7DaySpend", "Last14DaySpend",
        (l7 - l14).alias("Last7DayGrowth"), growth_pct(l7, l14).alias("Last7DayGrowthPct"))


def status_costs(usage: DataFrame, prices: DataFrame, timeline: DataFrame, as_of=None,
                 lookback_days: int = LOOKBACK_DAYS, num_slices: int | None = None) -> DataFrame:
    """C3 + C1 + F4: terminal run slices with the cost attributed to them, one row per usage record and slice.

    Columns: run keys, ``result_state``, ``run_as``, ``custom_tags``, the
    ordering columns, and ``status_list_cost`` / ``status_effective_cost``.
    Building it counts the usage window (and samples its keys where it needs more
    than one slice), then runs the checkpoint job of :func:`attribute_status_cost`.
    """
    window = jobs_usage(usage, as_of, lookback_days)
    bounds = attribution_bounds(window, num_slices)
    # inner joins commute: the timeline join sees the plain usage window, the price join then
    # prices the joined rows
    joined = priced_usage(timeline_hour_join(window, timeline, bounds.span), prices)
    return _attributed(joined.withColumn("run_as", F.col("identity_metadata.run_as")), bounds)


def summed_status_costs(usage: DataFrame, prices: DataFrame, timeline: DataFrame, as_of=None,
                        lookback_days: int = LOOKBACK_DAYS, num_slices: int | None = None) -> DataFrame:
    """:func:`status_costs` summed over the usage records that a run slice meets in one hour (for J4 and J5).

    The order of the attribution puts the slice before the record, so the records of one run,
    hour and usage end stand together on every slice, all terminal or none: what they carry and
    receive is their sum.  Priced usage is therefore summed to one row per run, hour and usage end before
    it meets the timeline, with the smallest user and tag set, and the joined rows grow with
    the slices instead of with the product of records and slices of an hour.
    """
    window = jobs_usage(usage, as_of, lookback_days)
    bounds = attribution_bounds(window, num_slices)
    cols = _job_columns(priced_usage(window.withColumn("_hour", hour_floor("usage_start_time")), prices), "_hour")
    cols = cols.where(F.col("job_id").isNotNull() & F.col("run_id").isNotNull())
    summed = sum_then_pick(cols, [*RUN_KEYS, "_hour", "usage_end_time"], COSTS).select(
        "workspace_id", F.struct("job_id", F.col("run_id").alias("job_run_id")).alias("usage_metadata"),
        F.col("_hour").alias("usage_start_time"), "usage_end_time", "run_as", "custom_tags", *COSTS)
    return _attributed(timeline_hour_join(summed, timeline, bounds.span), bounds)


def _attributed(joined: DataFrame, bounds: Bounds) -> DataFrame:
    """F4 on priced usage joined to run slices."""
    keep = ["workspace_id", "job_id", "run_id", "usage_end_time", "period_end_time", "period_start_time",
            "slice_id", "record_id", "price_start_time", "result_state", "custom_tags", "list_cost", "effective_cost", "run_as"]
    rows = joined.select(*[c for c in keep if c in joined.columns])
    # only terminal rows are in the result, so only they carry tags and user through the shuffle
    ends = F.col("result_state").isNotNull()
    rows = rows.withColumns({c: F.when(ends, F.col(c)) for c in ("custom_tags", "run_as")})
    order = attribution_order(rows)
    if bounds.ranges:
        return attribute_in_ranges(rows, order, bounds.ranges)
    return attribute_status_cost(rows, order, bounds.cuts)


def _is_failure(state: Column) -> Column:
    return F.when(state.isin(*FAILURE_STATES), 1).otherwise(0)


def failed_jobs_analysis(usage: DataFrame, prices: DataFrame, timeline: DataFrame, jobs: DataFrame,
                         as_of=None, lookback_days: int = LOOKBACK_DAYS, num_slices: int | None = None,
                         attributed: DataFrame | None = None) -> DataFrame:
    """Terminal runs, failures, success ratio and failure cost per job.

    Runs are the terminal timeline slices ending in the window; failure cost is
    the status cost (F4) of slices in ERROR / FAILED / TIMED_OUT.  Jobs without
    failures are kept (NULL cost).  ``attributed`` may pass a precomputed
    :func:`summed_status_costs` result (shared with J5 during a refresh).
    """
    if attributed is None:
        attributed = summed_status_costs(usage, prices, timeline, as_of, lookback_days, num_slices)
    failure_costs = sum_then_pick(with_tags_key(attributed.where(F.col("result_state").isin(*FAILURE_STATES))),
                                  JOB_KEYS, STATUS_COSTS).select(
        *JOB_KEYS, "run_as", "custom_tags", F.col("status_list_cost").alias("failure_list_cost"),
        F.col("status_effective_cost").alias("failure_effective_cost"))
    since = midnight(days_before(as_of, lookback_days))
    terminal = timeline.where(F.col("result_state").isNotNull() & (F.col("period_end_time") >= since))
    per_job = terminal.groupBy(*JOB_KEYS).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(_is_failure(F.col("result_state"))).cast("long").alias("failures"),
        F.max("period_end_time").alias("last_seen_date"))
    ratio = (F.lit(1.0) - F.coalesce(F.try_divide(F.col("failures").cast("double"), F.col("runs").cast("double")),
                                      F.lit(0.0))) * 100
    return (per_job.join(_job_names(jobs), JOB_KEYS, "left")
            .join(failure_costs, JOB_KEYS, "left")
            .select("name", "workspace_id", "job_id", "runs", "run_as", "custom_tags", "failures",
                    ratio.alias("success_ratio"), "failure_list_cost", "failure_effective_cost", "last_seen_date"))


def terminal_slices(timeline: DataFrame) -> DataFrame:
    """Terminal slices of runs; a run without one of its keys cannot be matched to its repairs."""
    return timeline.where(F.col("result_state").isNotNull() & F.col("workspace_id").isNotNull() & F.col("job_id").isNotNull()
                          & F.col("run_id").isNotNull())


def run_totals(slices: DataFrame) -> DataFrame:
    """Per run the count of terminal slices, their first end and the last successful end."""
    end = F.col("period_end_time")
    return slices.groupBy(*RUN_KEYS).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.min(end).alias("_first_end"),
        F.max(F.when(F.col("result_state") == SUCCEEDED, end)).alias("_success_end"))


def merge_run_totals(totals: DataFrame) -> DataFrame:
    """Totals of disjoint sets of slices merged per run."""
    return totals.groupBy(*RUN_KEYS).agg(
        F.sum("_cnt").alias("_cnt"), F.min("_first_end").alias("_first_end"), F.max("_success_end").alias("_success_end"))


def job_retry_patterns(usage: DataFrame, prices: DataFrame, timeline: DataFrame, jobs: DataFrame,
                       as_of=None, lookback_days: int = LOOKBACK_DAYS, num_slices: int | None = None,
                       attributed: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Runs with more than one terminal slice (whole history), their repair count,
    unsuccessful cost (window) and time from first terminal slice to last success.

    The unsuccessful cost is summed over all non-SUCCEEDED states of the run.  ``totals`` may
    pass the stored totals of all runs (:mod:`costlens.plans.run_state`).
    """
    if attributed is None:
        attributed = summed_status_costs(usage, prices, timeline, as_of, lookback_days, num_slices)
    unsuccessful = sum_then_pick(with_tags_key(attributed.where(F.col("result_state") != SUCCEEDED)),
                                 RUN_KEYS, STATUS_COSTS).select(
        *RUN_KEYS, "run_as", "custom_tags", F.col("status_list_cost").alias("repair_list_cost"),
        F.col("status_effective_cost").alias("repair_effective_cost"))
    if totals is None:
        totals = run_totals(terminal_slices(timeline))
    repaired = totals.where(F.col("_cnt") > 1)
    repair_time = F.when(F.col("_success_end").isNotNull(),
                         seconds_between(F.col("_first_end"), F.col("_success_end")))
    return (repaired.join(_job_names(jobs), JOB_KEYS, "left")
            .join(unsuccessful, RUN_KEYS, "left")
            .select("name", "workspace_id", "job_id", "run_id", "run_as", "custom_tags",
                    (F.col("_cnt") - 1).alias("repairs"), "repair_list_cost", "repair_effective_cost",
                    repair_time.alias("repair_time_seconds")))
