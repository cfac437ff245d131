"""Views assembled from stored days: equal to the view over the window after changes, reading only the changed days."""

import datetime as dt
import uuid

import pytest
from conftest import SF_SMALL, price_row, prices_df, usage_df, usage_row
from pyspark.sql import functions as F

from costlens.plans import daily, refresh
from costlens.sources import fixtures
from costlens.suite.portable import portable

AS_OF = dt.date(2024, 1, 31)
LATE, GONE = dt.date(2024, 1, 9), dt.date(2024, 1, 12)


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


def rows(df):
    return sorted(portable(df).select(sorted(df.columns)).collect(), key=repr)


@pytest.fixture(scope="module")
def given(spark):
    t = fixtures.load_all(spark, SF_SMALL)
    return t["usage"].checkpoint(), t["list_prices"].checkpoint()


@pytest.mark.parametrize("name", sorted(daily.DAILY_VIEWS))
def test_equal_to_the_view_after_days_change(spark, database, given, name):
    """Days arrive in two steps, then one day gets late rows and another loses all of its rows."""
    usage, prices = given
    tables = {"usage": usage.where(F.col("usage_date") != F.lit(GONE)), "list_prices": prices}
    first = usage.where((F.col("usage_date") != F.lit(LATE)) | (F.col("usage_quantity") > 3))
    step = dt.date(2024, 1, 20)
    assert len(daily.advance_days(spark, name, first, prices, step, database)) == 31
    types = lambda df: [(f.name, f.dataType) for f in df.schema]
    done = daily.advance_days(spark, name, tables["usage"], prices, AS_OF, database, [LATE, GONE])
    assert done == [LATE, GONE, *(step + dt.timedelta(days=n) for n in range(1, 12))]
    got, want = daily.from_days(spark, name, usage, prices, AS_OF, database), refresh.VIEWS[name](tables, AS_OF)
    assert types(got) == types(want)
    assert rows(got) == rows(want)
    assert daily.advance_days(spark, name, usage, prices, AS_OF, database) == []


@pytest.mark.parametrize("name", ["user_spend_alerts", "serverless_consumption_by_tag"])
def test_only_changed_days_are_read(spark, database, given, name, tmp_path):
    """Wrong amounts on all days but the changed one leave no trace, and the day is a partition filter."""
    usage, prices = given
    daily.advance_days(spark, name, usage, prices, AS_OF, database)
    wrong = usage.withColumn("usage_quantity", F.when(F.col("usage_date") == F.lit(LATE), F.col("usage_quantity"))
                             .otherwise(F.col("usage_quantity") * 1000).cast(usage.schema["usage_quantity"].dataType))
    assert daily.advance_days(spark, name, wrong, prices, AS_OF, database, [LATE]) == [LATE]
    want = refresh.VIEWS[name]({"usage": usage, "list_prices": prices}, AS_OF)
    assert rows(daily.from_days(spark, name, wrong, prices, AS_OF, database)) == rows(want)
    usage.write.partitionBy("usage_date").parquet(f"{tmp_path}/usage")
    plan = daily.day_sums(daily.DAILY_VIEWS[name], spark.read.parquet(f"{tmp_path}/usage"), prices, [LATE])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in text and "2024-01-09" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_null_keys_late_days_and_no_usage(spark, database):
    """A null user is a group of its own; days without rows count; an empty table gives an empty view."""
    prices = prices_df(spark, [price_row("X_SERVERLESS_Y", "2023-01-01T00:00:00", None, "2.0", "1.5")])
    usage = usage_df(spark, [
        usage_row(1, "2024-01-30T01:00:00", sku="X_SERVERLESS_Y", run_as=None, qty="1.00"),
        usage_row(2, "2024-01-20T01:00:00", sku="X_SERVERLESS_Y", run_as=None, qty="3.00"),
        usage_row(3, "2024-02-02T01:00:00", sku="X_SERVERLESS_Y", run_as="b", qty="5.00")])
    name = "user_spend_alerts"
    with pytest.raises(LookupError):
        daily.from_days(spark, name, usage, prices, AS_OF, database)
    daily.advance_days(spark, name, usage, prices, AS_OF, database)
    view = lambda: {r.run_as: float(r.list_cost) for r in daily.from_days(
        spark, name, usage, prices, AS_OF, database).collect()}
    assert view() == {None: 8.0}
    daily.advance_days(spark, name, usage, prices, AS_OF, database, [dt.date(2024, 2, 2)])
    assert view() == {None: 8.0, "b": 10.0}
    daily.advance_days(spark, name, usage.limit(0), prices, AS_OF, database,
                       [dt.date(2024, 1, 20), dt.date(2024, 1, 30), dt.date(2024, 2, 2)])
    assert view() == {}


def test_a_second_writer_is_refused(spark, database, given, monkeypatch):
    """Of two steps from one state the later commit is refused and leaves no files."""
    usage, prices = given
    name = "job_spend_alerts"
    daily.advance_days(spark, name, usage, prices, AS_OF, database)
    begin = daily.begin_version

    def slow(spark_, table):
        version = begin(spark_, table)
        monkeypatch.setattr(daily, "begin_version", begin)
        daily.advance_days(spark, name, usage, prices, AS_OF, database, [GONE])
        return version

    monkeypatch.setattr(daily, "begin_version", slow)
    with pytest.raises(refresh.RefreshConflict):
        daily.advance_days(spark, name, usage.limit(0), prices, AS_OF, database, [LATE])
    want = refresh.VIEWS[name]({"usage": usage, "list_prices": prices}, AS_OF)
    assert rows(daily.from_days(spark, name, usage, prices, AS_OF, database)) == rows(want)


def test_steps_out_of_use_are_removed(spark, database, given):
    usage, prices = given
    name = "serverless_job_spend"
    store = f"{refresh.database_location(spark, database)}/daily/{name}"
    steps = lambda: {f.getPath().getName() for f in (lambda fs, p: fs.listStatus(p))(*refresh.folder(spark, store))}
    for _ in range(4):
        daily.advance_days(spark, name, usage, prices, AS_OF, database, daily.window_days(spark, AS_OF))
        assert len(steps()) <= 2
