"""Display, coercion, top-k and presentation helpers."""

from pyspark.sql import functions as F

from costlens.functions.text import display_name, format_currency, format_large_number, run_label
from costlens.operators.topk import safe_top_k
from costlens.plans.dashboard import coerce_numeric
from costlens.plans.refresh import VIEW_ORDER, VIEWS, sorted_view
from costlens.plans.tagging import update_tags
from costlens.sources import schemas


def test_display_text(spark):
    df = spark.createDataFrame([("\t \n", "7"), (None, "8"), ("a very long job name indeed", "9")], "n string, id string")
    rows = df.select(display_name("n", "id").alias("d"), run_label("n", "id").alias("r")).collect()
    assert [r.d for r in rows] == ["Job ID: 7", "Job ID: 8", "a very long job name indeed"]
    assert [r.r for r in rows] == ["Run 7", "Run 8", "a very long job name..."]


def test_number_formats(spark):
    df = spark.createDataFrame([(1234567.891,), (None,), (-3.5,), (999.0,), (2500.0,)], "x double")
    got = df.select(format_currency("x").alias("c"), format_large_number("x").alias("n")).collect()
    assert [r.c for r in got] == ["$1,234,567.89", "$0.00", "$-3.50", "$999.00", "$2,500.00"]
    assert [r.n for r in got] == ["1.2M", "0", "-3.5", "999.0", "2.5K"]


def test_number_formats_round_as_fixed_point_formats_do(spark):
    import random
    rng = random.Random(5)
    values = [0.25, 0.15, 1250.0, 0.005, 2.675, 999.95, -0.004, 1e6] + [i / 200 for i in range(-400, 400)] + \
        [round(rng.uniform(-1e3, 1e7), 3) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", format_currency("v").alias("c"), format_large_number("v").alias("n")).collect()
    for r in rows:
        assert r.c == f"${r.v:,.2f}"
        assert r.n == (f"{r.v / 1e6:.1f}M" if r.v >= 1e6 else f"{r.v / 1e3:.1f}K" if r.v >= 1e3 else f"{r.v:.1f}")


def test_coerce_and_safe_top_k(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "x"), ("c", "2.5")], "k string, v string")
    assert dict(coerce_numeric(df, ["v", "missing"]).dtypes)["v"] == "double"
    assert [r.k for r in safe_top_k(df, 5, "v", ["k"]).collect()] == ["a", "c"]
    assert safe_top_k(df, 5, "nope") is df


def test_update_single_resource(spark):
    res = spark.createDataFrame([("cluster", "c1", "one", "RUNNING", {"a": "1"}, None, None, True, 1)], schemas.RESOURCES)
    r = update_tags(res, "cluster", "c1", {"b": "2"}, "replace").first()
    assert r.success and r.previous_tags == {"a": "1"} and r.new_tags == {"b": "2"} and r.operation == "replace"


def test_every_view_has_a_presentation_order(spark):
    assert set(VIEW_ORDER) == set(VIEWS)
    df = spark.createDataFrame([("w", "1", 1.0), ("w", "2", 3.0), ("w", "3", None)],
                               "workspace_id string, job_id string, list_cost double")
    assert [r.job_id for r in sorted_view("most_expensive_jobs", df).collect()] == ["2", "1", "3"]


def test_tag_key_totals_equal_unpacked_totals(spark):
    import datetime as dt
    from conftest import SF_SMALL
    from costlens.plans import dashboard as K
    from costlens.plans import serverless as S
    from costlens.sources import fixtures
    t = fixtures.load_all(spark, SF_SMALL)
    view = S.serverless_consumption_by_tag(t["usage"], t["list_prices"], dt.date(2024, 1, 31))
    unpacked = K.unpack_tags(view)
    keys = K.top_tag_keys(unpacked, k=1000)
    assert keys.agg(F.sum("effective_cost")).first()[0] == unpacked.agg(F.sum("effective_cost")).first()[0]
