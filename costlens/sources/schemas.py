"""Input schemas: the columns the cost views read from the billing and job tables."""

from pyspark.sql import types as T

S, B, L, TS, D = T.StringType(), T.BooleanType(), T.LongType(), T.TimestampType(), T.DateType()
MONEY_QTY = T.DecimalType(18, 2)
PRICE = T.DecimalType(18, 4)
TAGS = T.MapType(S, S)


def _fields(*pairs):
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


USAGE = _fields(
    ("record_id", L), ("account_id", S), ("workspace_id", S), ("cloud", S), ("sku_name", S),
    ("billing_origin_product", S), ("usage_unit", S), ("usage_quantity", MONEY_QTY),
    ("usage_start_time", TS), ("usage_end_time", TS), ("usage_date", D), ("custom_tags", TAGS),
    ("usage_metadata", _fields(("job_id", S), ("job_run_id", S), ("job_name", S), ("notebook_id", S),
                               ("notebook_path", S), ("endpoint_name", S))),
    ("identity_metadata", _fields(("run_as", S))),
    ("product_features", _fields(("is_serverless", B), ("model_serving", _fields(("offering_type", S))))),
)

LIST_PRICES = _fields(
    ("account_id", S), ("cloud", S), ("sku_name", S), ("usage_unit", S),
    ("price_start_time", TS), ("price_end_time", TS),
    ("pricing", _fields(("default", PRICE), ("effective_list", _fields(("default", PRICE))))),
)

JOBS = _fields(("workspace_id", S), ("job_id", S), ("name", S), ("change_time", TS))

JOB_RUN_TIMELINE = _fields(
    ("slice_id", L), ("workspace_id", S), ("job_id", S), ("run_id", S),
    ("period_start_time", TS), ("period_end_time", TS), ("result_state", S),
)

SERVED_ENTITIES = _fields(
    ("account_id", S), ("endpoint_name", S), ("endpoint_id", S), ("created_by", S),
    ("served_entity_name", S), ("entity_type", S), ("custom_model_config", S), ("external_model_config", S),
)

# Resource snapshots as the workspace APIs list them (inputs of the inventory).
CLUSTERS = _fields(("cluster_id", S), ("cluster_name", S), ("state", S), ("custom_tags", TAGS))
WAREHOUSES = _fields(("warehouse_id", S), ("name", S), ("state", S), ("cluster_size", S), ("tags", TAGS))
JOB_SETTINGS = _fields(("job_id", S), ("creator_user_name", S), ("settings", _fields(("name", S), ("tags", TAGS))))
PIPELINES = _fields(("pipeline_id", S), ("state", S), ("spec", _fields(("name", S), ("configuration", TAGS))))

RESOURCES = _fields(
    ("resource_type", S), ("resource_id", S), ("resource_name", S), ("state", S),
    ("tags", TAGS), ("cluster_size", S), ("creator_user_name", S), ("taggable", B), ("tag_count", T.IntegerType()),
)

TAG_REQUESTS = _fields(("resource_type", S), ("resource_id", S))
