"""Usage-to-run-timeline join (C3) and status cost attribution.

C3 — hour-range join
    A usage record belongs to a run slice when workspace, job and run match and
    ``hour(usage_start) ∈ [hour(period_start), hour(period_end)]``.  Each slice
    is expanded to the hours it covers within the usage time span, which turns
    the range into an equi key ``(workspace, job, run, hour)``: no residual
    range test, and a long run is spread over many join keys instead of one.
    Several slices in one hour all match the same usage record (the fan-out of
    the original is kept).

F4 — status cost attribution
    Over all joined rows in the global order ``(workspace, job, run,
    usage_end_time, tie-breaks)`` the original takes a running sum of cost and,
    on the rows that carry a ``result_state``, the difference to the previous
    such row.  Each terminal row therefore receives all cost since the previous
    terminal row *anywhere* before it, including the unterminated tail of the
    previous run.  Written literally that is one window over a single partition.

    Here it is a parallel prefix scan.  The global order is cut into slices at
    run keys and usage ends that a key sample gives (:func:`attribution_bounds`),
    so a row's slice is a pure function of its keys, whatever is recomputed.
    A slice's number is its shuffle partition (``repartitionById``), so every task has
    one slice; one window pass computes its running sums, and only its terminal rows
    and its last row are kept and checkpointed.  One row per slice yields the
    cost carried into each slice; the first terminal row of a slice adds that
    carry.  Only those summary rows ever meet in a single partition.

    A pass has at most ``PASS_SLICES`` slices.  A window that needs more is first
    written in as many ranges of the order as it takes, and every range is
    sliced by a sample of its own rows, so the rows of a slice stay near
    ``SLICE_ROWS`` whatever the size of the window.  (Rows of one run and one usage
    end are never separated.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import hour_floor
from ..session import ensure_checkpoint_dir

RUN_KEYS = ["workspace_id", "job_id", "run_id"]
DEFAULT_TIEBREAK = ["period_end_time", "period_start_time", "slice_id", "record_id", "price_start_time"]
COSTS = ("list_cost", "effective_cost")

#: Rows of a slice, slices of a pass, and keys sampled for every slice (its size has a deviation of about 1/6).
SLICE_ROWS = 250_000
PASS_SLICES = 4096
KEYS_PER_SLICE = 32


class Bounds(NamedTuple):
    """First and last usage start, the last (run keys, usage end) of every slice but the last,
    and the same for the ranges that are sliced each for itself (none if one pass does)."""

    span: tuple
    cuts: list[tuple]
    ranges: list[tuple]


def _sampled_cuts(keys: DataFrame, draw: Column, slices: int) -> list[tuple]:
    """At most ``slices - 1`` ascending values of the first four columns that cut rows into about equal slices.

    The driver gets the ``KEYS_PER_SLICE * slices`` keys of the smallest ``draw``.
    """
    if slices <= 1:
        return []
    sample = keys.withColumn("_draw", draw).orderBy("_draw").limit(KEYS_PER_SLICE * slices).collect()
    found = sorted((tuple(r)[:4] for r in sample), key=lambda k: [(x is not None, x) for x in k])
    cuts = [found[len(found) * i // slices - 1] for i in range(1, slices) if len(found) * i // slices]
    return list(dict.fromkeys(cuts))


def attribution_bounds(usage: DataFrame, num_slices: int | None = None, slice_rows: int = SLICE_ROWS,
                       pass_slices: int = PASS_SLICES) -> Bounds:
    """Slice bounds and time span of a usage window, from its keys.

    The number of slices follows the number of rows; a window of one slice is only
    counted.  Beyond ``pass_slices`` slices the bounds are those of ranges of that many slices.
    """
    start = F.col("usage_start_time")
    seen = usage.agg(F.count(F.lit(1)).alias("rows"), F.min(start).alias("lo"), F.max(start).alias("hi")).first()
    slices = num_slices or seen["rows"] // slice_rows + 1
    keys = usage.select("workspace_id", F.col("usage_metadata.job_id").alias("job_id"),
                        F.col("usage_metadata.job_run_id").alias("run_id"), "usage_end_time", "record_id", "usage_start_time")
    draw = F.xxhash64("record_id", "usage_start_time")
    parts = slices if slices <= pass_slices else -(-slices // pass_slices)
    cuts = _sampled_cuts(keys, draw, parts)
    span = (seen["lo"], seen["hi"])
    return Bounds(span, cuts, []) if slices <= pass_slices else Bounds(span, [], cuts)


def slice_of(order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Index of the slice of a row, how many cuts its first keys are above: halving over one array literal."""
    if not cuts:
        return F.lit(0)
    # times as microseconds; the array is folded into one literal of the plan
    rows = [[*k[:3], None if k[3] is None else round(k[3].timestamp() * 1_000_000)] for k in cuts]
    kind = "array<struct<w:string,j:string,r:string,t:bigint>>"
    bounds = F.from_json(F.lit(json.dumps([dict(zip("wjrt", k)) for k in rows])), kind)
    key = F.struct(*[F.col(c).cast("string").alias(n) for c, n in zip(order, "wjr")],
                   F.unix_micros(F.col(order[3]).cast("timestamp")).alias("t"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = key <= F.get(bounds, mid)
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(
            F.when(below, at["lo"]).otherwise(mid + 1).alias("lo"), F.when(below, mid).otherwise(at["hi"]).alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda at: at["lo"])


def timeline_hour_join(usage: DataFrame, timeline: DataFrame, span: tuple | None = None) -> DataFrame:
    """Usage rows joined to the run slices whose hour range covers their start.

    Output: the usage columns plus ``job_id, run_id, result_state,
    period_start_time, period_end_time`` (and ``slice_id`` when present) of the
    timeline.

    Before expanding and shuffling the timeline, slices that cannot reach any
    usage start are dropped: a slice matches only if ``hour(period_start) <=
    max(usage_start)`` and ``period_end + 1 hour > min(usage_start)``.  The
    bounds are ``span`` (first and last usage start) or else come from one scalar
    subquery over the (already filtered) usage, so a 30-day usage window does not
    shuffle years of run history, and a long slice is expanded only over the
    hours inside that span.
    """
    start = F.col("usage_start_time")
    if span is None:
        found = usage.select(F.struct(F.min(start).alias("lo"), F.max(start).alias("hi"))).scalar()
        lo, hi = found.getField("lo"), found.getField("hi")
    else:
        lo, hi = (F.lit(x).cast("timestamp") for x in span)
    ps, pe = hour_floor("period_start_time"), hour_floor("period_end_time")
    reachable = (ps <= hi) & (F.col("period_end_time") + F.expr("INTERVAL 1 HOUR") > lo)
    # only the hours inside the usage span can match, however long the slice lasts
    first, last = F.greatest(ps, hour_floor(lo)), F.least(pe, hour_floor(hi))
    hours = F.when(last >= first, F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    extra = [c for c in ("slice_id",) if c in timeline.columns]
    t = timeline.where(reachable).select(
        F.col("workspace_id").alias("_t_ws"), "job_id", "run_id", "result_state",
        "period_start_time", "period_end_time", *extra,
        F.explode(hours).alias("_t_hour"),
    )
    # The expansion multiplies rows, so size estimates of ``t`` are no bound for a broadcast:
    # always a sort-merge join on the four keys.
    t = t.hint("merge")
    u = usage.withColumn("_u_hour", hour_floor("usage_start_time"))
    cond = [
        F.col("workspace_id") == F.col("_t_ws"),
        F.col("usage_metadata.job_id") == F.col("job_id"),
        F.col("usage_metadata.job_run_id") == F.col("run_id"),
        F.col("_u_hour") == F.col("_t_hour"),
    ]
    return u.join(t, cond, "inner").drop("_t_ws", "_t_hour", "_u_hour")


def attribution_order(df: DataFrame, tiebreak: Sequence[str] | None = None) -> list[str]:
    """Global order of the attribution: run keys, usage end, then tie-breaks present in ``df``."""
    tb = [c for c in (tiebreak if tiebreak is not None else DEFAULT_TIEBREAK) if c in df.columns]
    return RUN_KEYS + ["usage_end_time"] + tb


def attribute_status_cost(rows: DataFrame, order: Sequence[str], cuts: Sequence[tuple] = (),
                          costs: Sequence[str] = COSTS) -> DataFrame:
    """terminal rows (``result_state`` not NULL) with ``status_<cost>`` columns.

    ``status_<cost>`` = sum of ``<cost>`` over all rows after the previous
    terminal row (in the global ``order``) up to and including this one.
    ``order`` must be a total order for the result to be deterministic.
    ``cuts`` are ascending values of the first columns of ``order`` that bound the
    slices; without any there is one slice.

    Building the result runs one Spark job: the terminal rows and the last row
    of every slice are checkpointed eagerly (to ``spark.checkpoint.dir``), as
    both the summary and the result read them.
    """
    return _carried(_scanned(rows, order, cuts, costs), costs)


def attribute_in_ranges(rows: DataFrame, order: Sequence[str], ranges: Sequence[tuple], slice_rows: int = SLICE_ROWS,
                        pass_slices: int = PASS_SLICES, costs: Sequence[str] = COSTS) -> DataFrame:
    """F4 over more slices than one pass has: the rows are written by ranges of the order, then
    every range is sliced and scanned by itself, and the carries of all slices are combined."""
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/attribution-{uuid.uuid4()}"
    rows.withColumn("_range", slice_of(order, ranges)).write.partitionBy("_range").parquet(folder)
    written = spark.read.schema(T.StructType([*rows.schema, T.StructField("_range", T.IntegerType())])).parquet(folder)
    scanned, first = None, 0
    for k in range(len(ranges) + 1):
        part = written.where(F.col("_range") == k).drop("_range")
        slices = min(pass_slices, part.count() // slice_rows + 1)
        cuts = _sampled_cuts(part.select(*order), F.xxhash64(*order), slices)
        local = _scanned(part, order, cuts, costs, first)
        scanned = local if scanned is None else scanned.unionByName(local)
        first += len(cuts) + 1
    return _carried(scanned, costs)


def _scanned(rows: DataFrame, order: Sequence[str], cuts: Sequence[tuple], costs: Sequence[str], first: int = 0) -> DataFrame:
    """Running sums within slices numbered from ``first``; keeps terminal rows and the last row of each slice."""
    ensure_checkpoint_dir(rows.sparkSession)
    asc = [F.col(c).asc_nulls_first() for c in order]
    is_term = F.col("result_state").isNotNull()
    ordered = Window.partitionBy("_slice").orderBy(*asc)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_slice", slice_of(order, cuts)).repartitionById(len(cuts) + 1, F.col("_slice"))
            .withColumns({f"_cum_{c}": F.sum(c).over(running) for c in costs})
            # same partitioning and order: evaluated in the same pass, no further shuffle or sort
            .withColumns({"_place": F.row_number().over(ordered),
                          "_end": F.lead(F.lit(False), 1, True).over(ordered),
                          "_seen": F.max(is_term.cast("int")).over(before),
                          **{f"_prev_{c}": F.last(F.when(is_term, F.struct(F.col(f"_cum_{c}").alias("v"))),
                                                  ignorenulls=True).over(before)["v"] for c in costs}})
            .where(is_term | F.col("_end"))
            .withColumn("_slice", F.col("_slice") + first)
            .checkpoint(eager=True))


def _carried(local: DataFrame, costs: Sequence[str]) -> DataFrame:
    """Adds to the first terminal row of every slice the cost carried into the slice."""
    is_term = F.col("result_state").isNotNull()
    # One row per slice: does it hold a terminal row, and the cost after its last one.
    last_key = F.when(is_term, F.col("_place"))
    summary = local.groupBy("_slice").agg(
        F.max(is_term.cast("int")).alias("_has"),
        *[F.max_by(f"_cum_{c}", "_place").alias(f"_tot_{c}") for c in costs],
        *[F.max_by(F.when(is_term, F.col(f"_cum_{c}")), last_key).alias(f"_last_{c}") for c in costs],
    ).withColumns({f"_tail_{c}": F.col(f"_tot_{c}") - F.coalesce(F.col(f"_last_{c}"), F.lit(0)) for c in costs})
    # Carry into slice k: tails of the slices since the last slice before k holding a terminal row.
    by_slice = Window.orderBy("_slice")
    summary = summary.withColumn("_grp", F.sum("_has").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    in_group = Window.partitionBy("_grp").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumns({f"_seg_{c}": F.sum(f"_tail_{c}").over(in_group) for c in costs})
    summary = summary.select("_slice", *[F.coalesce(F.lag(f"_seg_{c}").over(by_slice), F.lit(0)).alias(f"_in_{c}")
                                         for c in costs])

    term = local.where(is_term).withColumn("_first", F.coalesce(F.col("_seen"), F.lit(0)) == 0)
    # one row per slice: Spark broadcasts it where its measured size allows
    term = term.join(summary, "_slice", "left")
    out = term.withColumns({
        f"status_{c}": F.col(f"_cum_{c}") - F.coalesce(F.col(f"_prev_{c}"), F.lit(0))
        + F.when(F.col("_first"), F.coalesce(F.col(f"_in_{c}"), F.lit(0))).otherwise(F.lit(0))
        for c in costs})
    internal = [c for c in out.columns if c.startswith("_")]
    return out.drop(*internal)
