"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the fixture tables derived from the test data of ``sf_dir``
(:mod:`costlens.sources.fixtures`); the report date is fixed to
``2024-01-31`` so results are reproducible.  Results are rendered with
:func:`portable` so they compare directly with the DuckDB oracle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MERGE, REMOVE, REPLACE
from ..functions.tags import clean_tag_pairs, merge_tags, parse_tags, required_tag_list, tags_literal
from ..functions.text import display_name, format_large_number, format_money_columns, run_label
from ..operators.attribution import timeline_hour_join
from ..operators.latest import latest_jobs
from ..operators.pricing import POINT, priced_usage
from ..operators.topk import safe_top_k
from ..plans import dashboard as K
from ..plans import jobs as J
from ..plans import serverless as S
from ..plans import serving as V
from ..plans import tagging as L
from ..session import use_utc
from ..sources import catalog, fixtures
from .portable import portable

AS_OF = dt.date(2024, 1, 31)

QueryFn = Callable[[SparkSession, str], DataFrame]


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    use_utc(spark)
    return fixtures.Tables(spark, sf_dir)


def _u_p(fn) -> QueryFn:
    def run(spark, sf_dir):
        t = inputs(spark, sf_dir)
        return portable(fn(t["usage"], t["list_prices"], as_of=AS_OF))
    run.__doc__ = fn.__doc__
    return run


def _u_p_j(fn) -> QueryFn:
    def run(spark, sf_dir):
        t = inputs(spark, sf_dir)
        return portable(fn(t["usage"], t["list_prices"], t["jobs"], as_of=AS_OF))
    run.__doc__ = fn.__doc__
    return run


def _u_p_t_j(fn) -> QueryFn:
    def run(spark, sf_dir):
        t = inputs(spark, sf_dir)
        return portable(fn(t["usage"], t["list_prices"], t["job_run_timeline"], t["jobs"], as_of=AS_OF))
    run.__doc__ = fn.__doc__
    return run


def model_serving_costs(spark, sf_dir):
    t = inputs(spark, sf_dir)
    return portable(V.model_serving_costs(t["usage"], t["list_prices"], t["served_entities"], as_of=AS_OF))


VIEW_QUERIES: dict[str, QueryFn] = {
    "most_expensive_jobs": _u_p_j(J.most_expensive_jobs),
    "most_expensive_job_runs": _u_p_j(J.most_expensive_job_runs),
    "job_spend_trend": _u_p_j(J.job_spend_trend),
    "failed_jobs_analysis": _u_p_t_j(J.failed_jobs_analysis),
    "job_retry_patterns": _u_p_t_j(J.job_retry_patterns),
    "workspace_spend_alerts": _u_p(S.workspace_spend_alerts),
    "user_spend_alerts": _u_p(S.user_spend_alerts),
    "job_spend_alerts": _u_p(S.job_spend_alerts),
    "serverless_notebook_spend": _u_p(S.serverless_notebook_spend),
    "serverless_job_spend": _u_p(S.serverless_job_spend),
    "user_serverless_consumption": _u_p(S.user_serverless_consumption),
    "serverless_consumption_by_tag": _u_p(S.serverless_consumption_by_tag),
    "model_serving_costs": model_serving_costs,
    "batch_inference_costs": _u_p(V.batch_inference_costs),
}


VIEW_INPUTS = {
    "most_expensive_jobs": (J.most_expensive_jobs, ("usage", "list_prices", "jobs")),
    "most_expensive_job_runs": (J.most_expensive_job_runs, ("usage", "list_prices", "jobs")),
    "job_spend_trend": (J.job_spend_trend, ("usage", "list_prices", "jobs")),
    "failed_jobs_analysis": (J.failed_jobs_analysis, ("usage", "list_prices", "job_run_timeline", "jobs")),
    "user_spend_alerts": (S.user_spend_alerts, ("usage", "list_prices")),
    "serverless_notebook_spend": (S.serverless_notebook_spend, ("usage", "list_prices")),
    "serverless_job_spend": (S.serverless_job_spend, ("usage", "list_prices")),
    "user_serverless_consumption": (S.user_serverless_consumption, ("usage", "list_prices")),
    "serverless_consumption_by_tag": (S.serverless_consumption_by_tag, ("usage", "list_prices")),
    "model_serving_costs": (V.model_serving_costs, ("usage", "list_prices", "served_entities")),
    "batch_inference_costs": (V.batch_inference_costs, ("usage", "list_prices")),
    "daily_job_costs": (K.daily_job_costs, ("usage", "list_prices")),
}


def _view(spark, sf_dir, name):
    """A cost view as a DataFrame (native types, not rendered)."""
    t = inputs(spark, sf_dir)
    build, names = VIEW_INPUTS[name]
    return build(*(t[n] for n in names), AS_OF)


def _on(view: str, report, **kw) -> QueryFn:
    def run(spark, sf_dir):
        return portable(report(_view(spark, sf_dir, view), **kw))
    run.__doc__ = report.__doc__
    return run


def _resources(spark, sf_dir):
    t = inputs(spark, sf_dir)
    return L.resource_inventory(t["clusters"], t["warehouses"], t["job_settings"], t["pipelines"])


def _on_resources(report, with_requests=False, **kw) -> QueryFn:
    def run(spark, sf_dir):
        res = _resources(spark, sf_dir)
        if with_requests:
            return portable(report(res, fixtures.tag_requests(spark, res), **kw))
        return portable(report(res, **kw))
    run.__doc__ = report.__doc__
    return run


def c1_price_join_containment(spark, sf_dir):
    """C1 over the whole usage table."""
    t = inputs(spark, sf_dir)
    return portable(priced_usage(t["usage"], t["list_prices"]).select(
        "record_id", "price_start_time", "list_cost", "effective_cost"))


def c2_price_join_point(spark, sf_dir):
    """C2 over the whole usage table."""
    t = inputs(spark, sf_dir)
    return portable(priced_usage(t["usage"], t["list_prices"], POINT).select(
        "record_id", "price_start_time", "list_cost", "effective_cost"))


def c3_timeline_hour_join(spark, sf_dir):
    """C3 over the whole usage and timeline tables."""
    t = inputs(spark, sf_dir)
    return timeline_hour_join(t["usage"], t["job_run_timeline"]).select("record_id", "slice_id", "result_state")


def c10_served_entity_join(spark, sf_dir):
    """C10 over the whole usage and served-entity tables."""
    t = inputs(spark, sf_dir)
    return V.join_served_entities(t["usage"], t["served_entities"], V.BLOCK_ENTITIES).select(
        "record_id", "served_entity_name", "entity_type")


def f1_latest_job_version(spark, sf_dir):
    """latest definition of every job."""
    return latest_jobs(inputs(spark, sf_dir)["jobs"]).select("workspace_id", "job_id", "name", "change_time")


def f4_status_cost_attribution(spark, sf_dir):
    """cost attributed to every terminal run slice (jobs usage, 30 days)."""
    t = inputs(spark, sf_dir)
    return portable(J.status_costs(t["usage"], t["list_prices"], t["job_run_timeline"], AS_OF).select(
        "record_id", "slice_id", "result_state", "status_list_cost", "status_effective_cost"))


def i7_parse_tags(spark, sf_dir):
    """JSON property text of every event parsed to a tag map."""
    use_utc(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return portable(ev.select("event_id", parse_tags("props").alias("tags")))


def a6_read_view(spark, sf_dir):
    """Filtered, capped read of the most-expensive-jobs view."""
    v = _view(spark, sf_dir, "most_expensive_jobs")
    order = [F.col("effective_cost").desc_nulls_last(), F.col("workspace_id").asc_nulls_first(),
             F.col("job_id").asc_nulls_first()]
    return portable(catalog.query_view(v, {"workspace_id": ["1", "3"], "run_as": None}, 50, order))


def _parts(spark, sf_dir) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey"))


def _name() -> Column:
    """Names that are missing, blank in several ways, or text with white space around it."""
    k = F.col("k")
    return (F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "\t \n").when(k % 6 == 2, "")
            .when(k % 6 == 3, F.concat(F.lit("\t"), F.col("p_name"))).otherwise(F.col("p_name")))


def i7_parse_tag_text(spark, sf_dir):
    """I7 on text of every kind: objects, quoted objects, and what is no object."""
    k, brand = F.col("k"), F.col("p_brand")
    text = (F.when(k % 8 == 0, F.concat(F.lit('{"b":"'), brand, F.lit('"}')))
            .when(k % 8 == 1, F.concat(F.lit('{"b":"'), brand, F.lit('"} and more')))
            .when(k % 8 == 2, F.concat(F.lit("{'b':'"), brand, F.lit("'}")))
            .when(k % 8 == 3, F.concat(F.lit('"{""b"":""'), brand, F.lit('""}"')))
            .when(k % 8 == 4, F.concat(F.lit('{"b":"'), brand)).when(k % 8 == 5, "")
            .when(k % 8 == 6, F.concat(F.lit('{"b":"'), brand, F.lit('"} {"c":"d"}'))))
    return portable(_parts(spark, sf_dir).select("p_partkey", parse_tags(text).alias("tags")))


def i8_merge_tags(spark, sf_dir):
    """I8: all three operations on the tags of every resource."""
    change = tags_literal(TAG_CHANGE)
    return portable(_resources(spark, sf_dir).select(
        "resource_type", "resource_id", *[merge_tags("tags", change, op).alias(op) for op in (MERGE, REPLACE, REMOVE)]))


def i11_display_names(spark, sf_dir):
    """Display name and run label."""
    key = F.col("k").cast("string")
    return _parts(spark, sf_dir).select("p_partkey", display_name(_name(), key).alias("display"),
                                        run_label(_name(), key).alias("label"))


def i13_number_text(spark, sf_dir):
    """Money and large numbers, negative ones and exact halves among them."""
    use_utc(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice").cast("double") * 37).otherwise(F.lit(0.0))
    value = (F.col("l_orderkey") % 9000).cast("double") / 8 - 200 + wide
    value = F.when(F.col("l_linenumber") % 7 != 5, value)
    out = li.select("l_orderkey", "l_linenumber", value.alias("total_cost"), format_large_number(value).alias("large"))
    return format_money_columns(out)


def i15_required_tags(spark, sf_dir):
    """Tag keys typed as text."""
    text = F.concat(F.lit(" ,\t"), F.regexp_replace("p_name", " ", ",\t "), F.lit(" , \n"))
    return portable(_parts(spark, sf_dir).select("p_partkey", required_tag_list(text).alias("required")))


def i16_clean_pairs(spark, sf_dir):
    """I16: edited tag pairs."""
    def pair(key, value):
        return F.struct(key.alias("key"), value.alias("value"))
    brand = F.col("p_brand")
    pairs = F.array(pair(F.concat(F.lit("\t"), brand), F.col("p_type")), pair(F.lit(" "), F.col("p_type")),
                    pair(F.lit("blank"), F.lit("\n\t")), pair(F.lit("kind"), F.concat(F.col("p_type"), F.lit(" \n"))),
                    pair(brand, F.concat(F.lit(" "), F.col("p_name"))))
    return portable(_parts(spark, sf_dir).select("p_partkey", clean_tag_pairs(pairs).alias("tags")))


def g4_safe_top_k(spark, sf_dir):
    """Top-k by a metric stored as text, some of it no number."""
    use_utc(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return safe_top_k(o.select("o_orderkey", text.alias("price")), 25, "price", ["o_orderkey"])


def k22_coerce_numeric(spark, sf_dir):
    """Text columns to numbers."""
    use_utc(spark)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return K.coerce_numeric(o.select("o_orderkey", text.alias("price")), ["price", "absent"])


def l3_update_tags(spark, sf_dir):
    """L3: tag change of one resource."""
    return portable(L.update_tags(_resources(spark, sf_dir), "warehouse", "2", TAG_CHANGE))


TAG_CHANGE = {"environment": "production", "reviewed": "2024"}

OPERATOR_QUERIES: dict[str, QueryFn] = {
    "c1_price_join_containment": c1_price_join_containment,
    "c2_price_join_point": c2_price_join_point,
    "c3_timeline_hour_join": c3_timeline_hour_join,
    "c10_served_entity_join": c10_served_entity_join,
    "f1_latest_job_version": f1_latest_job_version,
    "f4_status_cost_attribution": f4_status_cost_attribution,
    "i7_parse_tags": i7_parse_tags,
    "a6_read_view": a6_read_view,
    "g4_safe_top_k": g4_safe_top_k,
    "i7_parse_tag_text": i7_parse_tag_text,
    "i8_merge_tags": i8_merge_tags,
    "i11_display_names": i11_display_names,
    "i13_number_text": i13_number_text,
    "i15_required_tags": i15_required_tags,
    "i16_clean_pairs": i16_clean_pairs,
    "k22_coerce_numeric": k22_coerce_numeric,
}

REPORT_QUERIES: dict[str, QueryFn] = {
    "k1_filter_jobs": _on("most_expensive_jobs", K.filter_view, workspaces=["0", "1", "2"], tag_key="env",
                          tag_values=["prod"]),
    "k2_job_metrics": _on("most_expensive_jobs", K.job_metrics),
    "k3_top_jobs_by_cost": _on("most_expensive_jobs", K.top_jobs_by_cost),
    "k4_top_users_by_job_cost": _on("most_expensive_jobs", K.top_users_by_cost),
    "k5_top_jobs_by_runs": _on("most_expensive_jobs", K.top_jobs_by_runs),
    "k6_run_metrics": _on("most_expensive_job_runs", K.run_metrics),
    "k6_filter_runs": _on("most_expensive_job_runs", K.filter_view, workspaces=["1", "2"], tag_key="env",
                          tag_values=["prod"]),
    "k7_top_runs_by_cost": _on("most_expensive_job_runs", K.top_runs_by_cost),
    "k7_top_users_by_run_cost": _on("most_expensive_job_runs", K.top_users_by_cost),
    "k8_top_jobs_by_run_count": _on("most_expensive_job_runs", K.top_jobs_by_run_count),
    "k9_trend_cards": _on("daily_job_costs", K.trend_cards),
    "k10_daily_cost": _on("daily_job_costs", K.daily_cost),
    "k11_top_trend_jobs": _on("daily_job_costs", K.top_trend_jobs),
    "k12_top_growth_jobs": _on("job_spend_trend", K.top_growth_jobs),
    "k13_failure_metrics": _on("failed_jobs_analysis", K.failure_metrics),
    "k14_most_failures": _on("failed_jobs_analysis", K.most_failures),
    "k14_top_failure_cost": _on("failed_jobs_analysis", K.top_failure_cost),
    "k15_serverless_job_metrics": _on("serverless_job_spend", K.serverless_job_metrics),
    "k15_top_serverless_jobs": _on("serverless_job_spend", K.top_serverless_jobs),
    "k16_notebook_metrics": _on("serverless_notebook_spend", K.notebook_metrics),
    "k16_top_notebook_users": _on("serverless_notebook_spend", K.top_users_by_cost),
    "k17_unpack_tags": _on("serverless_consumption_by_tag", K.unpack_tags),
    "k18_top_tag_keys": _on("serverless_consumption_by_tag", lambda v: K.top_tag_keys(K.unpack_tags(v))),
    "k18_top_tag_values": _on("serverless_consumption_by_tag", lambda v: K.top_tag_values(K.unpack_tags(v), "team")),
    "k19_serving_metrics": _on("model_serving_costs", K.serving_metrics),
    "k19_filter_serving": _on("model_serving_costs", K.filter_view, endpoints=["ep-1", "ep-2"],
                              created_by=["owner0@x.io", "owner1@x.io"], tag_key="env", tag_values=["prod"]),
    "k19_cost_by_entity_type": _on("model_serving_costs", K.cost_by_entity_type),
    "k19_top_endpoints": _on("model_serving_costs", K.top_endpoints),
    "k19_top_served_entities": _on("model_serving_costs", K.top_served_entities),
    "k20_batch_metrics": _on("batch_inference_costs", K.batch_metrics),
    "k20_top_batch_users": _on("batch_inference_costs", K.top_users_by_cost, cost="total_effective_cost"),
    "k20_daily_endpoint_cost": _on("batch_inference_costs", K.daily_endpoint_cost),
    "k21_user_metrics": _on("user_serverless_consumption", K.user_metrics),
    "k21_top_users": _on("user_serverless_consumption", K.top_users_by_cost),
    "k21_jobs_vs_notebooks": _on("user_serverless_consumption", K.jobs_vs_notebooks),
    "k21_top_users_t7d": _on("user_spend_alerts", K.top_users_by_cost, cost="t7d_effective_cost"),
    "k21_top_users_t14d": _on("user_spend_alerts", K.top_users_by_cost, cost="t14d_effective_cost"),
    "k21_top_users_total": _on("user_spend_alerts", K.top_users_by_cost, cost="effective_cost"),
    "k23_tag_key_options": _on("most_expensive_jobs", K.tag_keys),
    "k23_user_options": _on("most_expensive_jobs", K.filter_options, col="run_as"),
    "k23_job_name_options": _on("most_expensive_jobs", K.filter_options, col="name"),
    "k23_tag_value_options": _on("most_expensive_jobs", K.tag_values, key="team"),
    "k23_job_id_options": _on("most_expensive_jobs", K.filter_options, col="job_id"),
    "k23_workspace_options": _on("most_expensive_jobs", K.filter_options, col="workspace_id"),
    "k23_endpoint_options": _on("model_serving_costs", K.filter_options, col="endpoint_name"),
    "k23_created_by_options": _on("model_serving_costs", K.filter_options, col="created_by"),
    "k23_jobs_page_options": _on("most_expensive_jobs", K.page_options, cols=["run_as", "name", "job_id", "workspace_id"]),
    "k23_serving_page_options": _on("model_serving_costs", K.page_options,
                                    cols=["endpoint_name", "created_by", "served_entity_name", "workspace_id"], tags_col=None),
    "k24_detail_table": _on("most_expensive_jobs", K.detail_table, sort_col="effective_cost",
                            keys=["workspace_id", "job_id"]),
}

TAG_QUERIES: dict[str, QueryFn] = {
    "l1_resource_inventory": _on_resources(lambda r: r),
    "l2_list_tags": _on_resources(L.list_tags, with_requests=True),
    "l4_bulk_update_tags": _on_resources(L.bulk_update_tags, with_requests=True, tags=TAG_CHANGE),
    "l3_update_tags": l3_update_tags,
    "l4_bulk_replace_tags": _on_resources(L.bulk_update_tags, with_requests=True, tags=TAG_CHANGE, operation=REPLACE),
    "l4_bulk_remove_tags": _on_resources(L.bulk_update_tags, with_requests=True, tags=TAG_CHANGE, operation=REMOVE),
    "l5_find_by_tag_key": _on_resources(L.find_resources_by_tag, key="team"),
    "l5_find_by_tag_value": _on_resources(L.find_resources_by_tag, key="environment", value="production"),
    "l6_compliance_details": _on_resources(L.compliance_details),
    "l7_compliance_by_type": _on_resources(L.compliance_by_type),
    "l8_compliance_summary": _on_resources(L.compliance_summary),
    "e16_compliance_rollup": _on_resources(L.compliance_rollup),
    "l9_untagged": _on_resources(L.untagged),
    "l9_untagged_clusters": _on_resources(L.untagged, resource_type="cluster"),
    "l10_resource_counts": _on_resources(L.resource_counts),
}


def all_queries() -> dict[str, QueryFn]:
    return {**VIEW_QUERIES, **OPERATOR_QUERIES, **REPORT_QUERIES, **TAG_QUERIES}
