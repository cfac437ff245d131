"""Membership, tag and latest-date filters (D14–D17) and report captions."""

import datetime as dt

from pyspark.sql import functions as F

from costlens.operators.filters import filter_in, filter_tag, since_latest
from costlens.plans import dashboard as K
from costlens.sources import schemas


def _df(spark):
    return spark.createDataFrame(
        [("a", "1", {"env": "prod"}, dt.date(2024, 1, 30), 1.0), ("b", "2", {"env": "dev"}, dt.date(2024, 1, 20), 2.0),
         ("c", "3", None, dt.date(2024, 1, 1), 3.0), (None, "4", {"team": "x"}, dt.date(2023, 12, 1), 4.0)],
        "run_as string, job_id string, custom_tags map<string,string>, usage_date date, effective_cost double")


def test_filter_in_semantics(spark):
    df = _df(spark)
    assert filter_in(df, {"run_as": ["a", "b"], "job_id": []}).count() == 2       # empty list selects all
    assert filter_in(df, {"job_id": "3", "run_as": None}).count() == 1             # scalar equality, None ignored
    assert filter_in(df, {"no_such_column": ["x"]}).count() == 4                   # unknown column ignored


def test_tag_filter_needs_key_and_values(spark):
    df = _df(spark)
    assert {r.job_id for r in filter_tag(df, "env", ["prod", "dev"]).collect()} == {"1", "2"}
    assert filter_tag(df, "env", []).count() == 4
    assert filter_tag(df, None, ["prod"]).count() == 4


def test_since_latest_and_trend_cards(spark):
    df = _df(spark)
    assert {r.job_id for r in since_latest(df, "usage_date", 10).collect()} == {"1", "2"}
    cards = K.trend_cards(df).first()
    assert (cards.t7d_cost, cards.t14d_cost, cards.t30d_cost) == (1.0, 3.0, 6.0)


def test_detail_table_caption_and_cap(spark):
    df = _df(spark).withColumn("list_cost", F.col("effective_cost") * 1000)
    rows = K.detail_table(df, "effective_cost", ["job_id"], max_rows=3).collect()
    assert [r.job_id for r in rows] == ["4", "3", "2"]
    assert rows[0].caption == "Showing 3 of 4 rows" and rows[0].list_cost == "$4,000.00"


def test_compliance_rollup_has_type_rows_and_total(spark):
    from costlens.plans.tagging import compliance_rollup
    res = spark.createDataFrame([("cluster", "1", "a", "x", {"environment": "p", "team": "t", "owner": "o"}, None, None, True, 3),
                                 ("cluster", "2", "b", "x", {}, None, None, True, 0), ("job", "3", "c", None, {"team": "t"}, None, None, True, 1)],
                                schemas.RESOURCES)
    got = {r.resource_type: (r.total, r.compliant, r.non_compliant) for r in compliance_rollup(res).collect()}
    assert got == {"cluster": (2, 1, 1), "job": (1, 0, 1), None: (3, 1, 2)}
