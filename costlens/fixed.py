"""Fixed values.

Values the results depend on and that must equal the source application's:
product and unit names, SKU patterns, run states, default windows and list
sizes, resource kinds, tag-tool messages and display formats.
"""

# ---- fixed values: billing ----------------------------------------------------------------
PRODUCT_JOBS = "JOBS"
PRODUCT_INTERACTIVE = "INTERACTIVE"
PRODUCT_MODEL_SERVING = "MODEL_SERVING"
UNIT_DBU = "DBU"
SKU_SERVERLESS = "%SERVERLESS%"
SKU_JOBS_SERVERLESS_COMPUTE = "%JOBS_SERVERLESS_COMPUTE%"
SKU_SERVERLESS_REAL_TIME_INFERENCE = "%SERVERLESS_REAL_TIME_INFERENCE%"
OFFERING_BATCH_INFERENCE = "BATCH_INFERENCE"

# ---- fixed values: job runs ---------------------------------------------------------------
FAILURE_STATES = ["ERROR", "FAILED", "TIMED_OUT"]
SUCCEEDED = "SUCCEEDED"

# ---- fixed values: windows (days) and list sizes -----------------------------------------
LOOKBACK_DAYS = 30
TREND_LOOKBACK_DAYS = 14
TOP_K = 25
TOP_ENDPOINTS = 10
DETAIL_ROWS = 100

# ---- fixed values: resource tagging -------------------------------------------------------
RESOURCE_TYPES = ["cluster", "warehouse", "job", "pipeline"]
NOT_FOUND = {"cluster": "Cluster {} not found", "warehouse": "Warehouse {} not found", "job": "Job {} not found",
             "pipeline": "Pipeline {} not found"}
NOT_TAGGABLE = {**NOT_FOUND, "job": "Job {} not found or has no settings",
                "pipeline": "Pipeline {} not found or has no spec"}
UNKNOWN_TYPE = "Unknown resource type: {}"
UNKNOWN_STATE = "unknown"
UNKNOWN_NAME = "Unknown"
DEFAULT_REQUIRED_TAGS = ["environment", "team", "owner"]
MERGE, REPLACE, REMOVE = "merge", "replace", "remove"

# ---- fixed values: display ----------------------------------------------------------------
JOB_ID_LABEL = "Job ID: "
RUN_LABEL = "Run "
RUN_NAME_CHARS = 20
ELLIPSIS = "..."
NO_AMOUNT = "$0.00"
NO_NUMBER = "0"
CAPTION = "Showing %d of %d rows"
