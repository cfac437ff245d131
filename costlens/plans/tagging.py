"""Resource tag inventory, changes, search and compliance.

The source application reads resources from workspace APIs one call at a
time.  Here the four resource listings are DataFrames (snapshots), so every
operation is a projection, join or aggregate over the whole inventory.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import (DEFAULT_REQUIRED_TAGS, NOT_FOUND, NOT_TAGGABLE, RESOURCE_TYPES, UNKNOWN_NAME, UNKNOWN_STATE,
                     UNKNOWN_TYPE)
from ..functions.tags import MERGE, merge_tags, missing_tags, tag_count, tags_literal, tags_or_empty
from ..sources import schemas



def resource_inventory(clusters: DataFrame, warehouses: DataFrame, job_settings: DataFrame,
                       pipelines: DataFrame) -> DataFrame:
    """L1: one ``resources`` table from the four listings, with ``tag_count``.

    Missing state -> ``unknown`` (jobs have no state); job and pipeline names
    default to ``Unknown`` without settings/spec; missing tags -> ``{}``;
    pipeline tags are the spec configuration.  Warehouses have a
    ``cluster_size`` and jobs a ``creator_user_name``; ``taggable`` is false for a
    job without settings or a pipeline without a spec, whose tags cannot be changed.
    """
    unknown = F.lit(UNKNOWN_STATE)
    none = F.lit(None).cast("string")

    def part(df, kind, key, name, state, tags, size=none, creator=none, taggable=F.lit(True)):
        return df.select(F.lit(kind).alias("resource_type"), F.col(key).alias("resource_id"), name.alias("resource_name"),
                         state.alias("state"), tags_or_empty(tags).alias("tags"), size.alias("cluster_size"),
                         creator.alias("creator_user_name"), taggable.alias("taggable"))

    def named(holder):
        return F.when(F.col(holder).isNull(), F.lit(UNKNOWN_NAME)).otherwise(F.col(f"{holder}.name"))

    parts = [
        part(clusters, "cluster", "cluster_id", F.col("cluster_name"), F.coalesce("state", unknown), "custom_tags"),
        part(warehouses, "warehouse", "warehouse_id", F.col("name"), F.coalesce("state", unknown), "tags",
             size=F.col("cluster_size")),
        part(job_settings, "job", "job_id", named("settings"), none, "settings.tags",
             creator=F.col("creator_user_name"), taggable=F.col("settings").isNotNull()),
        part(pipelines, "pipeline", "pipeline_id", named("spec"), F.coalesce("state", unknown), "spec.configuration",
             taggable=F.col("spec").isNotNull()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("tag_count", tag_count("tags"))


def _requests_with_resources(resources: DataFrame, requests: DataFrame) -> DataFrame:
    r = resources.select("resource_type", "resource_id", "resource_name", "tags", "taggable", F.lit(True).alias("_found"))
    return requests.select("resource_type", "resource_id").join(r, ["resource_type", "resource_id"], "left")


def _error(ok, messages: Mapping[str, str]):
    """Message of a request that did not succeed, NULL otherwise."""
    kind = F.col("resource_type")
    text = F.when(~kind.isin(*RESOURCE_TYPES), F.format_string(UNKNOWN_TYPE.replace("{}", "%s"), kind))
    for t, m in messages.items():
        text = text.when(~ok & (kind == t), F.format_string(m.replace("{}", "%s"), F.col("resource_id")))
    return text


def _known(flag):
    return F.coalesce(flag, F.lit(False)) & F.col("resource_type").isin(*RESOURCE_TYPES)


def list_tags(resources: DataFrame, requests: DataFrame) -> DataFrame:
    """L2: tags and tag count of each requested resource; unknown ones get ``error``.

    A job without settings or a pipeline without a spec has no tags.
    """
    j = _requests_with_resources(resources, requests)
    ok = _known(F.col("_found"))
    return j.select("resource_type", "resource_id", ok.alias("success"),
                    F.when(ok, F.col("tags")).alias("tags"),
                    F.when(ok, tag_count("tags")).alias("tag_count"),
                    _error(ok, NOT_FOUND).alias("error"))


def bulk_update_tags(resources: DataFrame, requests: DataFrame, tags: Mapping[str, str],
                     operation: str = MERGE) -> DataFrame:
    """L4 (and L3 for a single request): one result row per request.

    ``previous_tags`` / ``new_tags`` per resource; an unknown type or id, a job
    without settings or a pipeline without a spec gives ``success = false`` with an
    error message and does not stop the others.  Requests act in turn: a resource requested
    again finds the tags that its first request left (the same change again alters nothing more).
    Repeated requests are counted before the join, so a resource requested very often is one row of it.
    """
    counted = requests.groupBy("resource_type", "resource_id").agg(F.count("*").alias("_times"))
    r = resources.select("resource_type", "resource_id", "tags", "taggable")
    j = (counted.join(r, ["resource_type", "resource_id"], "left")
         .withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))))
    ok = _known(F.col("taggable"))
    new = merge_tags("tags", tags_literal(tags), operation)
    previous = F.when(F.col("_turn") == 1, F.col("tags")).otherwise(new)
    return j.select("resource_type", "resource_id", ok.alias("success"),
                    F.when(ok, previous).alias("previous_tags"),
                    F.when(ok, new).alias("new_tags"),
                    F.when(ok, F.lit(operation)).alias("operation"),
                    _error(ok, NOT_TAGGABLE).alias("error"))


def updates_in_turn(resources: DataFrame, requests: DataFrame,
                    changes: Sequence[tuple[Mapping[str, str], str]]) -> DataFrame:
    """L4 several times over the same requests: the results of every change (``turn`` from 1), each on
    the tags that the ones before left."""
    state, out = resources, None
    for turn, (tags, operation) in enumerate(changes, 1):
        result = bulk_update_tags(state, requests, tags, operation).withColumn("turn", F.lit(turn))
        out = result if out is None else out.unionByName(result)
        state = apply_tag_updates(state, requests, tags, operation)
    return out


def update_tags(resources: DataFrame, resource_type: str, resource_id: str, tags: Mapping[str, str],
                operation: str = MERGE) -> DataFrame:
    """L3: tag change of one resource (a one-request bulk update)."""
    spark = resources.sparkSession
    req = spark.createDataFrame([(resource_type, str(resource_id))], schemas.TAG_REQUESTS)
    return bulk_update_tags(resources, req, tags, operation)


def apply_tag_updates(resources: DataFrame, requests: DataFrame, tags: Mapping[str, str],
                      operation: str = MERGE) -> DataFrame:
    """The resource snapshot after a bulk update: requested resources that can have tags get their new ones."""
    hit = requests.select("resource_type", "resource_id").distinct().withColumn("_hit", F.lit(True))
    j = resources.join(hit, ["resource_type", "resource_id"], "left")
    new = F.when(F.col("_hit") & F.col("taggable"), merge_tags("tags", tags_literal(tags), operation)).otherwise(F.col("tags"))
    return j.withColumn("tags", new).withColumn("tag_count", tag_count("tags")).drop("_hit")


def find_resources_by_tag(resources: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Resources holding tag ``key`` (and ``value`` when given); exact, case-sensitive."""
    v = F.element_at(F.col("tags"), F.lit(key))
    cond = F.map_contains_key(F.col("tags"), F.lit(key))
    if value is not None:
        cond = cond & (v == F.lit(value))
    return resources.where(cond).select("resource_type", "resource_id", "resource_name",
                                        v.alias("tag_value"), F.col("tags").alias("all_tags"))


def compliance_details(resources: DataFrame, required: Sequence[str] = DEFAULT_REQUIRED_TAGS) -> DataFrame:
    """Non-compliant resources with their missing required tags (in the order required)."""
    m = missing_tags("tags", list(required))
    return resources.withColumn("missing_tags", m).where(F.size("missing_tags") > 0).select(
        "resource_type", "resource_id", F.coalesce("resource_name", F.lit(UNKNOWN_NAME)).alias("resource_name"),
        "missing_tags", F.col("tags").alias("current_tags"))


def _compliant(required: Sequence[str]):
    return (F.size(missing_tags("tags", list(required))) == 0).cast("int")


def _pct(part, total):
    return F.when(total > 0, part.cast("double") / total.cast("double") * 100).otherwise(F.lit(0.0))


def compliance_by_type(resources: DataFrame, required: Sequence[str] = DEFAULT_REQUIRED_TAGS) -> DataFrame:
    """Per resource type (all four, zero when absent): total, compliant, non-compliant, %."""
    per = resources.groupBy("resource_type").agg(F.count(F.lit(1)).alias("total"),
                                                 F.sum(_compliant(required)).alias("compliant"))
    spark: SparkSession = resources.sparkSession
    kinds = spark.createDataFrame([(t,) for t in RESOURCE_TYPES], "resource_type string")
    j = kinds.join(per, "resource_type", "left")
    total, comp = F.coalesce("total", F.lit(0)).cast("long"), F.coalesce("compliant", F.lit(0)).cast("long")
    return j.select("resource_type", total.alias("total"), comp.alias("compliant"),
                    (total - comp).alias("non_compliant"), _pct(comp, total).alias("compliance_percentage"))


def compliance_summary(resources: DataFrame, required: Sequence[str] = DEFAULT_REQUIRED_TAGS) -> DataFrame:
    """Overall totals and compliance % (0 for an empty inventory)."""
    s = resources.agg(F.count(F.lit(1)).alias("t"), F.sum(_compliant(required)).alias("c"))
    total, comp = F.col("t").cast("long"), F.coalesce("c", F.lit(0)).cast("long")
    return s.select(total.alias("total_resources"), comp.alias("compliant_resources"),
                    (total - comp).alias("non_compliant_resources"), _pct(comp, total).alias("compliance_percentage"))


def compliance_rollup(resources: DataFrame, required: Sequence[str] = DEFAULT_REQUIRED_TAGS) -> DataFrame:
    """Per-type and overall compliance counts in one aggregation (``rollup``);
    the overall row has ``resource_type`` NULL."""
    per = resources.rollup("resource_type").agg(F.count(F.lit(1)).alias("total"),
                                                F.sum(_compliant(required)).cast("long").alias("compliant"))
    total, comp = F.col("total"), F.coalesce("compliant", F.lit(0)).cast("long")
    return per.select("resource_type", total.alias("total"), comp.alias("compliant"),
                      (total - comp).alias("non_compliant"), _pct(comp, total).alias("compliance_percentage"))


def untagged(resources: DataFrame, resource_type: str | None = None) -> DataFrame:
    """Resources without any tag (optionally of one type)."""
    df = resources.where(F.col("tag_count") == 0)
    return df.where(F.col("resource_type") == resource_type) if resource_type else df


def resource_counts(resources: DataFrame) -> DataFrame:
    """Number of resources per type."""
    return resources.groupBy("resource_type").agg(F.count(F.lit(1)).alias("resource_count"))
