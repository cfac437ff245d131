"""Stored run totals: equal to those of all slices after late and repeated deliveries, merges and refused writers."""

import datetime as dt
import random
import uuid

import pytest
from conftest import ts

from costlens.plans import refresh, run_state
from costlens.plans.jobs import run_totals, terminal_slices
from costlens.sources import schemas


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


def timeline(spark, rows):
    return spark.createDataFrame(rows, schemas.JOB_RUN_TIMELINE)


def history(n, seed=3):
    """Slices of few runs, a third of them of one run; some without an id, an end, a state or a key."""
    pick, out = random.Random(seed), set()
    for i in range(n):
        end = ts("2024-01-01T00:00:00") + dt.timedelta(hours=pick.randrange(400))
        run = "hot" if pick.random() < 0.35 else f"r{pick.randrange(30)}"
        out.add((None if pick.random() < 0.05 else i, "w" if pick.random() < 0.97 else None, "j", run, end - dt.timedelta(hours=1),
                 None if pick.random() < 0.05 else end, pick.choice(["SUCCEEDED", "FAILED", "TIMED_OUT", None])))
    ids = {(r[1], r[2], r[3], r[0], r[5], r[6]): r for r in out}
    return sorted(ids.values(), key=repr)


def state(spark, slices, database):
    return sorted(map(tuple, run_state.stored_run_totals(spark, slices, database).collect()), key=repr)


def full(slices):
    return sorted(map(tuple, run_totals(terminal_slices(slices)).collect()), key=repr)


@pytest.mark.parametrize("merge_steps", [16, 2])
def test_equal_to_all_slices_after_late_and_repeated_deliveries(spark, database, monkeypatch, merge_steps):
    monkeypatch.setattr(run_state, "MERGE_STEPS", merge_steps)
    rows = history(400)
    pick = random.Random(5)
    deliveries = [rows[:150], rows[100:300], [], pick.sample(rows[:300], 80) + rows[350:] + rows[350:360], rows[250:]]
    seen = set()
    for delivery in deliveries:
        run_state.advance_runs(spark, timeline(spark, delivery), database)
        seen |= set(delivery)
        assert state(spark, timeline(spark, rows), database) == full(timeline(spark, sorted(seen, key=repr)))
    assert len(seen) == len(rows)


def test_only_the_days_of_a_delivery_are_looked_up(spark, database):
    rows = history(200)
    run_state.advance_runs(spark, timeline(spark, rows), database)
    table, store = run_state._place(spark, database)
    some = timeline(spark, [r for r in rows if r[5] and r[5].date() == dt.date(2024, 1, 5)])
    like = terminal_slices(some).selectExpr(*run_state._SLICE, "to_date(period_end_time) AS end_date")
    files = run_state._counted(spark, table, store, like).inputFiles()
    assert {f for f in files if "end_date=" in f} and all("end_date=2024-01-05" in f for f in files if "end_date=" in f)


def test_an_empty_state_has_no_runs(spark, database):
    assert state(spark, timeline(spark, history(20)), database) == []


def test_a_second_writer_is_refused_and_can_deliver_again(spark, database, monkeypatch):
    rows = history(60)
    begin = run_state.begin_version

    def slow(spark_, table):
        version = begin(spark_, table)
        monkeypatch.setattr(run_state, "begin_version", begin)
        run_state.advance_runs(spark, timeline(spark, rows[:40]), database)
        return version

    monkeypatch.setattr(run_state, "begin_version", slow)
    with pytest.raises(refresh.RefreshConflict):
        run_state.advance_runs(spark, timeline(spark, rows[30:]), database)
    assert state(spark, timeline(spark, rows), database) == full(timeline(spark, rows[:40]))
    run_state.advance_runs(spark, timeline(spark, rows[30:]), database)
    assert state(spark, timeline(spark, rows), database) == full(timeline(spark, rows))
