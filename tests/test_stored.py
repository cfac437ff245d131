"""Stored tables and views: rows against SQL, commits of concurrent refreshes, positions in an order, changes in turn."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from costlens.operators.ranks import positions, ranged
from costlens.plans import refresh
from costlens.plans import tagging as L
from costlens.suite.check import compare, duck
from costlens.suite.stored import STORED_QUERIES, stored_oracle_sql

SQL = stored_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(STORED_QUERIES))
def test_stored_query_matches_sql(spark, con, name):
    info = compare(spark, con, name, STORED_QUERIES[name], SQL[name], SF_SMALL)
    assert info["ok"], info


@pytest.fixture
def view(spark):
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    return f"{name}.spend"


def written(spark, view, rows):
    version = refresh.begin_version(spark, view)
    spark.range(rows).write.saveAsTable(version.table)
    return version


def test_two_refreshes_and_a_reader(spark, view):
    """Of two refreshes from one version the second to commit is refused; neither drops what the other writes."""
    refresh.materialize(spark.range(1), view)
    reader = spark.table(view)
    slow = written(spark, view, 2)
    refresh.materialize(spark.range(3), view)  # begins and commits while the slow one is writing
    assert spark.catalog.tableExists(slow.table)
    assert spark.table(view).count() == 3 and reader.count() == 1
    with pytest.raises(refresh.RefreshConflict):
        refresh.commit_version(spark, slow)
    assert not spark.catalog.tableExists(slow.table)
    assert spark.table(view).count() == 3
    refresh.materialize(spark.range(4), view)
    assert spark.table(view).count() == 4


def test_a_late_switch_ends_on_the_last_commit(spark, view, monkeypatch):
    """A writer that claimed its number but switches after a later refresh does not bring its version back."""
    late = written(spark, view, 5)
    last = refresh._last_commit

    def meanwhile(spark_, commits):
        monkeypatch.setattr(refresh, "_last_commit", last)
        refresh.materialize(spark.range(6), view)  # commits the next number before the late writer looks
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM {late.table}")
        return last(spark_, commits)

    monkeypatch.setattr(refresh, "_last_commit", meanwhile)
    refresh.commit_version(spark, late)
    assert spark.table(view).count() == 6


def test_versions_before_the_previous_one_are_dropped(spark, view):
    for rows in (1, 2, 3, 4):
        refresh.materialize(spark.range(rows), view)
    database = view.partition(".")[0]
    tables = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database} LIKE 'spend__v*'").collect()]
    assert sorted(int(t.split("__v")[1].split("_")[0]) for t in tables) == [3, 4]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_positions_number_the_global_order(spark, parts):
    df = spark.range(1000, numPartitions=parts).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("n", F.when(F.col("g") > 0, F.col("v")))
    order = [F.col("n").desc_nulls_last(), F.col("v").asc()]
    got = {r["position"]: (r["n"], r["v"]) for r in positions(df, order).collect()}
    want = [(r["n"], r["v"]) for r in df.orderBy(*order).collect()]
    assert [got[i] for i in range(1, 1001)] == want
    assert positions(df.limit(0), order).collect() == []


def test_positions_need_no_window_over_all_rows(spark):
    plan = positions(spark.range(100).toDF("v"), [F.col("v").desc()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "row_number() windowspecdefinition(_range" in plan


def test_files_of_a_sorted_view_hold_ranges(spark, tmp_path):
    order = [F.col("v").desc()]
    path = str(tmp_path / "t")
    spark.range(20000, numPartitions=5).select((F.col("id") * 7919 % 20000).alias("v")).repartition(4).createOrReplaceTempView("src")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged(spark.table("src"), order).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = sorted((r["lo"], r["hi"]) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def resources(spark):
    return spark.createDataFrame([("cluster", "c1", "one", {"a": "1"}, True), ("job", "j1", "two", {}, False)],
                                 "resource_type string, resource_id string, resource_name string, tags map<string,string>, taggable boolean")


def test_a_resource_requested_twice_finds_the_first_result(spark):
    requests = spark.createDataFrame([("cluster", "c1")] * 3 + [("job", "j1")] * 2, "resource_type string, resource_id string")
    rows = L.bulk_update_tags(resources(spark), requests, {"b": "2"}).collect()
    previous = sorted(str(r["previous_tags"]) for r in rows if r["resource_type"] == "cluster")
    assert previous == sorted(map(str, [{"a": "1"}, {"a": "1", "b": "2"}, {"a": "1", "b": "2"}]))
    assert all(r["new_tags"] == {"a": "1", "b": "2"} for r in rows if r["success"])
    assert sum(not r["success"] for r in rows) == 2


def test_changes_in_turn(spark):
    requests = spark.createDataFrame([("cluster", "c1")], "resource_type string, resource_id string")
    rows = L.updates_in_turn(resources(spark), requests, [({"b": "2"}, "merge"), ({"a": "9"}, "remove"), ({"z": "0"}, "replace")])
    got = {r["turn"]: (r["previous_tags"], r["new_tags"]) for r in rows.collect()}
    assert got == {1: ({"a": "1"}, {"a": "1", "b": "2"}), 2: ({"a": "1", "b": "2"}, {"b": "2"}), 3: ({"b": "2"}, {"z": "0"})}
