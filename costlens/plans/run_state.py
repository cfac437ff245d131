"""Stored totals per job run, advanced by new timeline slices only (J5 without rereading the timeline).

J5 needs, over the whole history, the number of terminal slices of a run, their
first end and the last successful end.  All three merge, so a refresh adds the
totals of the slices delivered since the one before:

* ``runs/<step>``: one row per run of a step.  The state is the merge of the steps in
  use; every :data:`MERGE_STEPS` steps they are merged into one.
* ``slices/end_date=<day>/step=<step>``: keys of the terminal slices counted so far.  A
  delivered slice is looked up among the slices of its own end day, so only the
  days that occur in the delivery are read, and a slice delivered twice counts once.

The table ``job_runs__steps`` (one row per step) says which steps count; it is committed as
the versions of :mod:`costlens.plans.refresh` are, so a step counts as a whole or not at
all and of two writers the second is refused.

Edge cases: a slice is known by its run, ``slice_id``, end and state, nulls alike; equal
rows are one slice.  Slices without a state, workspace, job or run are in no total, as
in J5.  A slice without an end counts, under a day of its own.  A delivery may be late,
empty or repeat earlier ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .jobs import RUN_KEYS, merge_run_totals, run_totals, terminal_slices
from .refresh import RefreshConflict, begin_version, commit_version, database_location, folder

#: Steps in use from which on they are merged into one.
MERGE_STEPS = 16

_STEPS = "step string, in_use boolean"
_SLICE = [*RUN_KEYS, "slice_id", "period_end_time", "result_state"]
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name of a null


def _place(spark: SparkSession, database: str | None) -> tuple[str, str]:
    table = "job_runs__steps"
    return f"{database}.{table}" if database else table, f"{database_location(spark, database)}/job_runs"


def _steps(spark: SparkSession, table: str) -> DataFrame | None:
    return spark.table(table) if spark.catalog.tableExists(table) else None


def _in_use(spark: SparkSession, table: str) -> list[str]:
    steps = _steps(spark, table)
    return [] if steps is None else [r["step"] for r in steps.where("in_use").collect()]  # MERGE_STEPS at most


def _counted(spark: SparkSession, table: str, store: str, like: DataFrame) -> DataFrame | None:
    """Slices counted so far with the end days of ``like``."""
    steps = _steps(spark, table)
    days = [r["end_date"] for r in like.select("end_date").distinct().collect()]
    paths = [f"{store}/slices/end_date={d or _NO_DAY}" for d in days]
    paths = [p for p in paths if (lambda fs, where: fs.exists(where))(*folder(spark, p))]
    if steps is None or not paths:
        return None
    schema = like.select(*_SLICE, "end_date").schema.add("step", "string")
    found = spark.read.schema(schema).option("basePath", f"{store}/slices").parquet(*paths)
    return found.join(steps.select("step"), "step", "left_semi")


def advance_runs(spark: SparkSession, slices: DataFrame, database: str | None = None) -> None:
    """Count the delivered timeline ``slices`` that were not counted before."""
    ensure_checkpoint_dir(spark)
    table, store = _place(spark, database)
    version = begin_version(spark, table)  # before the steps are read: a commit in between refuses this one
    in_use = _in_use(spark, table)
    new = terminal_slices(slices).select(*_SLICE, F.to_date("period_end_time").alias("end_date")).distinct().checkpoint()
    counted = _counted(spark, table, store, new)
    if counted is not None:
        same = [new[c].eqNullSafe(counted[c]) for c in _SLICE]
        new = new.join(counted, same, "left_anti").checkpoint()
    step = f"s{uuid.uuid4().hex}"
    by_day = new.withColumn("step", F.lit(step)).hint("rebalance", "end_date")
    by_day.write.mode("append").partitionBy("end_date", "step").parquet(f"{store}/slices")
    totals = run_totals(new)
    merge = len(in_use) >= MERGE_STEPS
    if merge:
        totals = merge_run_totals(_stored(spark, store, in_use, totals).unionByName(totals))
    totals.write.parquet(f"{store}/runs/{step}")
    known = _steps(spark, table)
    rows = spark.createDataFrame([(step, True)], _STEPS)
    if known is not None:
        rows = known.select("step", F.lit(False).alias("in_use") if merge else F.col("in_use")).unionByName(rows)
    rows.coalesce(1).write.saveAsTable(version.table)
    try:
        commit_version(spark, version)
    except RefreshConflict:
        fs, where = folder(spark, f"{store}/runs/{step}")
        fs.delete(where, True)  # the slices of a step that is not in the table are not read
        raise


def _stored(spark: SparkSession, store: str, steps: list[str], like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(*(f"{store}/runs/{s}" for s in steps))


def stored_run_totals(spark: SparkSession, slices: DataFrame, database: str | None = None) -> DataFrame:
    """Totals of every run counted so far, as :func:`costlens.plans.jobs.run_totals` of all slices (which only give the types)."""
    table, store = _place(spark, database)
    like = run_totals(terminal_slices(slices))
    steps = _in_use(spark, table)
    return merge_run_totals(_stored(spark, store, steps, like)) if steps else like.limit(0)
