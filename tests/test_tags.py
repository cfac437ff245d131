"""Tag functions (I7–I10, I15, I16) and the tagging reports."""

from pyspark.sql import functions as F

from costlens.functions import tags as TG
from costlens.plans import tagging as L
from costlens.sources import schemas


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_parse_tags_variants(spark):
    df = spark.createDataFrame([(1, '{"a":"1","b":"x"}'), (2, '"{""a"":""1""}"'), (3, "not json"), (4, ""),
                                (5, None), (6, '{"n": 5}')], "id int, t string")
    got = {r.id: r.m for r in df.select("id", TG.parse_tags("t").alias("m")).collect()}
    assert got == {1: {"a": "1", "b": "x"}, 2: {"a": "1"}, 3: {}, 4: {}, 5: {}, 6: {"n": "5"}}


def test_merge_replace_remove_and_unknown_operation(spark):
    old = TG.tags_literal({"a": "1", "b": "2"})
    new = TG.tags_literal({"b": "9", "c": "3"})
    assert _one(spark, TG.merge_tags(old, new, "merge")) == {"a": "1", "b": "9", "c": "3"}
    assert _one(spark, TG.merge_tags(old, new, "replace")) == {"b": "9", "c": "3"}
    assert _one(spark, TG.merge_tags(old, TG.tags_literal({"b": "", "zz": ""}), "remove")) == {"a": "1"}
    assert _one(spark, TG.merge_tags(old, new, "something-else")) == {"a": "1", "b": "9", "c": "3"}
    assert _one(spark, TG.merge_tags(F.lit(None).cast(schemas.TAGS), new)) == {"b": "9", "c": "3"}


def test_merge_is_idempotent(spark):
    old = TG.tags_literal({"a": "1"})
    new = TG.tags_literal({"a": "2", "b": "3"})
    once = TG.merge_tags(old, new)
    assert _one(spark, TG.merge_tags(once, new)) == _one(spark, once)


def test_missing_tags_keeps_order_and_repeats(spark):
    m = TG.tags_literal({"team": "x"})
    assert _one(spark, TG.missing_tags(m, ["owner", "team", "env", "owner"])) == ["owner", "env", "owner"]
    assert _one(spark, TG.missing_tags(F.lit(None).cast(schemas.TAGS), [])) == []


def test_required_list_and_clean_pairs(spark):
    assert _one(spark, TG.required_tag_list(F.lit(" env, ,team ,,"))) == ["env", "team"]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
                      for k, v in [(" a ", "1"), ("b", " "), ("", "x"), ("a", "2")]])
    assert _one(spark, TG.clean_tag_pairs(pairs)) == {"a": "2"}


def test_tags_text_is_key_order_independent(spark):
    a = TG.tags_text(F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("2"), F.lit("1"))))
    assert _one(spark, a) == "a=1;b=2"


def _inventory(spark):
    clusters = spark.createDataFrame([("c1", "one", None, {"environment": "p", "team": "t", "owner": "o"}),
                                      ("c2", "two", "RUNNING", None)], schemas.CLUSTERS)
    warehouses = spark.createDataFrame([("w1", "wh", "STOPPED", "Small", {"environment": "p"})], schemas.WAREHOUSES)
    jobs = spark.createDataFrame([("1", "me", ("job", {"team": "t"})), ("2", "me", None)], schemas.JOB_SETTINGS)
    pipelines = spark.createDataFrame([], schemas.PIPELINES)
    return L.resource_inventory(clusters, warehouses, jobs, pipelines)


def test_inventory_defaults(spark):
    rows = {(r.resource_type, r.resource_id): r for r in _inventory(spark).collect()}
    assert rows[("cluster", "c1")].state == "unknown"
    assert rows[("cluster", "c2")].tags == {} and rows[("cluster", "c2")].tag_count == 0
    assert rows[("job", "2")].resource_name == "Unknown" and not rows[("job", "2")].taggable
    assert rows[("job", "1")].creator_user_name == "me" and rows[("warehouse", "w1")].cluster_size == "Small"


def test_compliance_counts_add_up_and_cover_all_types(spark):
    res = _inventory(spark)
    by_type = {r.resource_type: r for r in L.compliance_by_type(res).collect()}
    assert set(by_type) == {"cluster", "warehouse", "job", "pipeline"}
    assert by_type["pipeline"].total == 0 and by_type["pipeline"].compliance_percentage == 0.0
    assert all(r.compliant + r.non_compliant == r.total for r in by_type.values())
    s = L.compliance_summary(res).first()
    assert (s.total_resources, s.compliant_resources) == (5, 1)
    assert L.compliance_details(res).count() == 4
    assert L.compliance_details(res, []).count() == 0          # nothing required: all compliant


def test_empty_inventory_summary_is_zero(spark):
    empty = spark.createDataFrame([], schemas.RESOURCES)
    s = L.compliance_summary(empty).first()
    assert (s.total_resources, s.compliant_resources, s.compliance_percentage) == (0, 0, 0.0)


def test_bulk_update_reports_unknown_type_and_id(spark):
    res = _inventory(spark)
    req = spark.createDataFrame([("cluster", "c2"), ("cluster", "nope"), ("dashboard", "1"), ("job", "2"), ("job", "9"),
                                 ("pipeline", "p")], schemas.TAG_REQUESTS)
    got = {(r.resource_type, r.resource_id): r for r in L.bulk_update_tags(res, req, {"env": "x"}).collect()}
    assert got[("cluster", "c2")].success and got[("cluster", "c2")].new_tags == {"env": "x"}
    assert got[("cluster", "nope")].error == "Cluster nope not found"
    assert got[("dashboard", "1")].error == "Unknown resource type: dashboard"
    assert not got[("job", "2")].success
    assert got[("job", "2")].error == "Job 2 not found or has no settings"
    listed = {(r.resource_type, r.resource_id): r for r in L.list_tags(res, req).collect()}
    assert listed[("job", "2")].success and listed[("job", "2")].tags == {}
    assert listed[("job", "9")].error == "Job 9 not found" and listed[("pipeline", "p")].error == "Pipeline p not found"
    after = {r.resource_id: r.tags for r in L.apply_tag_updates(res, req, {"env": "x"}).collect()}
    assert after["c2"] == {"env": "x"} and after["2"] == {} and after["c1"]["owner"] == "o"


def test_find_by_tag_and_untagged(spark):
    res = _inventory(spark)
    assert {r.resource_id for r in L.find_resources_by_tag(res, "team").collect()} == {"c1", "1"}
    assert {r.resource_id for r in L.find_resources_by_tag(res, "environment", "p").collect()} == {"c1", "w1"}
    assert {r.resource_id for r in L.untagged(res).collect()} == {"c2", "2"}
