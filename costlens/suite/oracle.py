"""DuckDB oracle SQL for the registered queries.

Each statement re-derives the fixture tables from the raw test tables (the
same mapping as :mod:`costlens.sources.fixtures`, written in SQL) and computes
the result the straightforward way: literal range joins, ``QUALIFY`` for the
latest job version and one global window for the status cost attribution.
Tag maps are compared as canonical ``k=v;k=v`` text and money as DOUBLE.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2024-01-31'"


def tags_txt(map_expr: str) -> str:
    """Canonical text of a DuckDB MAP (sorted ``k=v`` joined by ``;``)."""
    return (f"array_to_string(list_sort(list_transform(map_entries({map_expr}), "
            f"lambda e: e.key || '=' || coalesce(e.value, ''))), ';')")


def json_map(json_expr: str) -> str:
    return f"CAST(CAST({json_expr} AS JSON) AS MAP(VARCHAR, VARCHAR))"


FIXTURES = {
    "usage": f"""
SELECT *, {json_map('tags_json')} AS tags_map, {tags_txt(json_map('tags_json'))} AS tags_txt,
  list_sort(map_entries({json_map('tags_json')})) AS tags_key FROM (
SELECT event_id AS record_id, CASE WHEN event_id % 19 = 0 THEN 'acct-2' ELSE 'acct-1' END AS account_id, CAST(user_id % 4 AS VARCHAR) AS workspace_id,
  CASE WHEN user_id % 3 = 0 THEN 'AWS' ELSE 'AZURE' END AS cloud,
  CASE event_type WHEN 'click' THEN 'PREMIUM_JOBS_SERVERLESS_COMPUTE_US' WHEN 'view' THEN 'PREMIUM_ALL_PURPOSE_SERVERLESS_COMPUTE_US'
    WHEN 'signup' THEN 'PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_US' ELSE 'PREMIUM_JOBS_COMPUTE' END AS sku_name,
  CASE event_type WHEN 'view' THEN 'INTERACTIVE' WHEN 'signup' THEN 'MODEL_SERVING' ELSE 'JOBS' END AS billing_origin_product,
  CASE WHEN event_id % 17 = 0 THEN 'GB' ELSE 'DBU' END AS usage_unit,
  CAST(CASE WHEN event_id % 23 = 0 THEN -value ELSE value END AS DECIMAL(18,2)) AS usage_quantity,
  date_trunc('hour', ts) AS usage_start_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS usage_end_time, CAST(ts AS DATE) AS usage_date,
  CASE WHEN event_type IN ('view','signup') OR event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS job_id,
  CASE WHEN event_type IN ('view','signup') OR event_id % 101 = 0 THEN NULL
    ELSE concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) END AS job_run_id,
  CASE WHEN event_type = 'click' AND event_id % 5 <> 0 THEN concat('job-', CAST(user_id AS VARCHAR)) END AS job_name,
  CASE WHEN event_type = 'view' THEN CAST(user_id % 20 AS VARCHAR) END AS notebook_id,
  CASE WHEN event_type = 'view' THEN concat('/nb/', CAST(user_id % 20 AS VARCHAR)) END AS notebook_path,
  CASE WHEN event_type = 'signup' THEN concat('ep-', CAST(user_id % 5 AS VARCHAR)) END AS endpoint_name,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('user', CAST(user_id % 40 AS VARCHAR), '@x.io') END AS run_as,
  event_type IN ('click','view','signup') AS is_serverless,
  CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'BATCH_INFERENCE' END AS offering_type,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('{{"env":"', CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END,
    '","team":"t', CAST(user_id % 5 AS VARCHAR), '"}}') END AS tags_json
FROM events) fx""",
    "list_prices": """
SELECT 'acct-1' AS account_id, cloud, sku_name, unit AS usage_unit, st AS price_start_time, en AS price_end_time,
  CAST(base * m AS DECIMAL(18,4)) AS list_default, CAST(base * m * 0.8 AS DECIMAL(18,4)) AS effective_default
FROM (VALUES ('PREMIUM_JOBS_SERVERLESS_COMPUTE_US', CAST(0.35 AS DECIMAL(10,4))), ('PREMIUM_ALL_PURPOSE_SERVERLESS_COMPUTE_US', CAST(0.75 AS DECIMAL(10,4))),
  ('PREMIUM_SERVERLESS_REAL_TIME_INFERENCE_US', CAST(0.07 AS DECIMAL(10,4))), ('PREMIUM_JOBS_COMPUTE', CAST(0.15 AS DECIMAL(10,4)))) s(sku_name, base)
CROSS JOIN (VALUES ('AWS'), ('AZURE')) c(cloud)
CROSS JOIN (VALUES ('DBU')) n(unit)
CROSS JOIN (VALUES (TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2024-01-15 12:30:00', CAST(1.0 AS DECIMAL(4,2))),
  (TIMESTAMP '2024-01-15 12:30:00', CAST(NULL AS TIMESTAMP), CAST(1.1 AS DECIMAL(4,2)))) e(st, en, m)""",
    "jobs": """
SELECT CAST(user_id % 4 AS VARCHAR) AS workspace_id, CAST(user_id AS VARCHAR) AS job_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('job-', CAST(user_id AS VARCHAR), '-v', CAST(event_id % 5 AS VARCHAR)) END AS name,
  ts AS change_time
FROM events WHERE event_type = 'signup'""",
    "job_run_timeline": """
SELECT event_id AS slice_id, CAST(user_id % 4 AS VARCHAR) AS workspace_id,
  CASE WHEN event_id % 89 <> 0 THEN CAST(user_id AS VARCHAR) END AS job_id,
  CASE WHEN event_id % 83 <> 0 THEN CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS run_id,
  ts AS period_start_time, CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL 190 MINUTE ELSE ts + INTERVAL 20 MINUTE END AS period_end_time,
  CASE WHEN event_type = 'purchase' THEN 'SUCCEEDED' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'TIMED_OUT'
    WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'CANCELLED' WHEN event_type = 'error' THEN 'FAILED' END AS result_state
FROM events WHERE event_type IN ('click','purchase','error')""",
    "served_entities": """
SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'acct-2' ELSE 'acct-1' END AS account_id, concat('ep-', CAST(s_suppkey % 5 AS VARCHAR)) AS endpoint_name,
  concat('id-', CAST(s_suppkey % 5 AS VARCHAR)) AS endpoint_id, concat('owner', CAST(s_suppkey % 3 AS VARCHAR), '@x.io') AS created_by,
  s_name AS served_entity_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'CUSTOM_MODEL' WHEN 1 THEN 'EXTERNAL_MODEL' ELSE 'FOUNDATION_MODEL' END AS entity_type,
  CASE WHEN s_suppkey % 3 = 0 THEN '{"v":1}' END AS custom_model_config, CASE WHEN s_suppkey % 3 = 1 THEN '{"p":"x"}' END AS external_model_config
FROM supplier""",
    "latest_jobs": """
SELECT workspace_id, job_id, name FROM jobs
QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC NULLS LAST, name DESC NULLS LAST) = 1""",
    # Containment price join; C2: point-in-time price join.
    "priced_c": """
SELECT u.*, p.price_start_time, u.usage_quantity * p.list_default AS list_cost, u.usage_quantity * p.effective_default AS effective_cost
FROM usage u JOIN list_prices p ON u.cloud = p.cloud AND u.sku_name = p.sku_name
  AND u.usage_start_time >= p.price_start_time AND (u.usage_end_time <= p.price_end_time OR p.price_end_time IS NULL)""",
    "priced_p": """
SELECT u.*, p.price_start_time, p.effective_default AS effective_price,
  u.usage_quantity * p.list_default AS list_cost, u.usage_quantity * p.effective_default AS effective_cost
FROM usage u JOIN list_prices p ON u.sku_name = p.sku_name AND u.cloud = p.cloud AND u.usage_unit = p.usage_unit
  AND u.account_id = p.account_id AND u.usage_start_time >= p.price_start_time
  AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time)""",
    # C3 + C1 + F4 literal: global running sum and lag over terminal rows.
    "status_rows": f"""
SELECT u.workspace_id, t.job_id, t.run_id, u.usage_end_time, t.period_end_time, t.period_start_time, t.slice_id, u.record_id,
  p.price_start_time, t.result_state, u.run_as, u.tags_txt, u.tags_key,
  u.usage_quantity * p.list_default AS list_cost, u.usage_quantity * p.effective_default AS effective_cost
FROM usage u
JOIN job_run_timeline t ON u.workspace_id = t.workspace_id AND u.job_id = t.job_id AND u.job_run_id = t.run_id
  AND u.usage_start_time >= date_trunc('hour', t.period_start_time)
  AND u.usage_start_time < date_trunc('hour', t.period_end_time) + INTERVAL 1 HOUR
JOIN list_prices p ON u.cloud = p.cloud AND u.sku_name = p.sku_name
  AND u.usage_start_time >= p.price_start_time AND (u.usage_end_time <= p.price_end_time OR p.price_end_time IS NULL)
WHERE u.billing_origin_product = 'JOBS' AND u.usage_date >= {AS_OF} - INTERVAL 30 DAY""",
    "status_cum": """
SELECT *, SUM(list_cost) OVER w AS cum_l, SUM(effective_cost) OVER w AS cum_e FROM status_rows
WINDOW w AS (ORDER BY workspace_id NULLS FIRST, job_id NULLS FIRST, run_id NULLS FIRST, usage_end_time NULLS FIRST,
  period_end_time NULLS FIRST, period_start_time NULLS FIRST, slice_id NULLS FIRST, record_id NULLS FIRST,
  price_start_time NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "status_cost": """
SELECT *, cum_l - COALESCE(LAG(cum_l) OVER w, 0) AS status_list_cost, cum_e - COALESCE(LAG(cum_e) OVER w, 0) AS status_effective_cost
FROM status_cum WHERE result_state IS NOT NULL
WINDOW w AS (ORDER BY workspace_id NULLS FIRST, job_id NULLS FIRST, run_id NULLS FIRST, usage_end_time NULLS FIRST,
  period_end_time NULLS FIRST, period_start_time NULLS FIRST, slice_id NULLS FIRST, record_id NULLS FIRST, price_start_time NULLS FIRST)""",
}

D = AS_OF


def _spend_alert_cols(_dbl) -> str:
    last7 = f"usage_date >= {D} - INTERVAL 7 DAY"
    prev7 = f"usage_date >= {D} - INTERVAL 14 DAY AND usage_date < {D} - INTERVAL 7 DAY"
    return f"""{_dbl('SUM(list_cost)')} AS list_cost, {_dbl('SUM(effective_cost)')} AS effective_cost,
  {_dbl(f'SUM(CASE WHEN {last7} THEN list_cost ELSE 0 END)')} AS t7d_list_cost,
  {_dbl(f'SUM(CASE WHEN {last7} THEN effective_cost ELSE 0 END)')} AS t7d_effective_cost,
  {_dbl(f'SUM(CASE WHEN {prev7} THEN list_cost ELSE 0 END)')} AS t14d_list_cost,
  {_dbl(f'SUM(CASE WHEN {prev7} THEN effective_cost ELSE 0 END)')} AS t14d_effective_cost"""


def _views(_dbl, raw: bool) -> dict[str, str]:
    tm1 = ', arg_min(tags_map, tags_key) AS tags_map' if raw else ''
    tm2 = ', first(tags_map) AS tags_map' if raw else ''
    tmsel = ', c.tags_map' if raw else ''
    tm3 = ', arg_min(u.tags_map, u.tags_key) AS tags_map' if raw else ''
    SERVERLESS_ALERT_FILTER = (f"sku_name LIKE '%SERVERLESS%' AND billing_origin_product IN ('JOBS', 'INTERACTIVE') "
                               f"AND usage_date >= {D} - INTERVAL 30 DAY")
    DBU_COLS = (f"{_dbl('SUM(usage_quantity)')} AS total_dbu, {_dbl('SUM(list_cost)')} AS list_cost, "
                f"{_dbl('SUM(effective_cost)')} AS effective_cost")
    SERVERLESS_DBU_FILTER = (f"billing_origin_product IN ('JOBS','INTERACTIVE') AND is_serverless AND usage_unit = 'DBU' "
                             f"AND usage_date >= {D} - INTERVAL 30 DAY")
    JOBS_30 = f"billing_origin_product = 'JOBS' AND usage_date >= {D} - INTERVAL 30 DAY"

    return {
        "most_expensive_jobs": f"""
    SELECT lj.name, c.job_id, c.workspace_id, c.runs, c.run_as, {_dbl('c.list_cost')} AS list_cost,
      {_dbl('c.effective_cost')} AS effective_cost, c.custom_tags, c.last_seen_date{tmsel}
    FROM (SELECT workspace_id, job_id, COUNT(DISTINCT job_run_id) AS runs, SUM(list_cost) AS list_cost,
            SUM(effective_cost) AS effective_cost, MIN(run_as) AS run_as, arg_min(tags_txt, tags_key) AS custom_tags,
            MAX(usage_end_time) AS last_seen_date{tm1}
          FROM priced_c WHERE {JOBS_30} GROUP BY workspace_id, job_id) c
    LEFT JOIN latest_jobs lj USING (workspace_id, job_id)""",
        "most_expensive_job_runs": f"""
    SELECT c.workspace_id, lj.name, c.job_id, c.run_id, c.run_as, {_dbl('c.list_cost')} AS list_cost,
      {_dbl('c.effective_cost')} AS effective_cost, c.custom_tags, c.last_seen_date
    FROM (SELECT workspace_id, job_id, job_run_id AS run_id, SUM(list_cost) AS list_cost, SUM(effective_cost) AS effective_cost,
            MIN(run_as) AS run_as, arg_min(tags_txt, tags_key) AS custom_tags, MAX(usage_end_time) AS last_seen_date
          FROM priced_c WHERE {JOBS_30} GROUP BY workspace_id, job_id, job_run_id) c
    LEFT JOIN latest_jobs lj USING (workspace_id, job_id)""",
        "job_spend_trend": f"""
    SELECT lj.name, s.workspace_id, s.job_id, s.sku_name, s.run_as, s.custom_tags,
      {_dbl('s.l7')} AS Last7DaySpend, {_dbl('s.l14')} AS Last14DaySpend, {_dbl('s.l7 - s.l14')} AS Last7DayGrowth,
      CASE WHEN s.l14 = 0 THEN NULL ELSE CAST(s.l7 - s.l14 AS DOUBLE) / CAST(s.l14 AS DOUBLE) * 100 END AS Last7DayGrowthPct
    FROM (SELECT workspace_id, job_id, run_as, sku_name, tags_txt AS custom_tags,
            SUM(CASE WHEN usage_end_time BETWEEN {D} - INTERVAL 8 DAY AND {D} - INTERVAL 1 DAY THEN effective_cost ELSE 0 END) AS l7,
            SUM(CASE WHEN usage_end_time BETWEEN {D} - INTERVAL 15 DAY AND {D} - INTERVAL 8 DAY THEN effective_cost ELSE 0 END) AS l14
          FROM priced_c WHERE billing_origin_product = 'JOBS' AND usage_date >= {D} - INTERVAL 14 DAY
          GROUP BY workspace_id, job_id, run_as, sku_name, tags_txt) s
    LEFT JOIN latest_jobs lj USING (workspace_id, job_id)""",
        # runs and failures are filtered counts of the job's terminal slices in the window
        "failed_jobs_analysis": f"""
    SELECT lj.name, t.workspace_id, t.job_id, t.runs, f.run_as, f.custom_tags, t.failures,
      (1 - CAST(t.failures AS DOUBLE) / t.runs) * 100 AS success_ratio, {_dbl('f.list_cost')} AS failure_list_cost,
      {_dbl('f.effective_cost')} AS failure_effective_cost, t.last_seen_date
    FROM (SELECT workspace_id, job_id, count(*) AS runs, count(*) FILTER (result_state IN ('ERROR', 'FAILED', 'TIMED_OUT')) AS failures,
            max(period_end_time) AS last_seen_date
          FROM job_run_timeline WHERE result_state IS NOT NULL AND period_end_time >= {D} - INTERVAL 30 DAY
          GROUP BY workspace_id, job_id) t
    LEFT JOIN latest_jobs lj USING (workspace_id, job_id)
    LEFT JOIN (SELECT workspace_id, job_id, min(run_as) AS run_as, arg_min(tags_txt, tags_key) AS custom_tags,
                 sum(status_list_cost) AS list_cost, sum(status_effective_cost) AS effective_cost
               FROM status_cost WHERE result_state IN ('ERROR', 'FAILED', 'TIMED_OUT') GROUP BY workspace_id, job_id) f
      USING (workspace_id, job_id)""",
        "job_retry_patterns": f"""
    SELECT lj.name, r.workspace_id, r.job_id, r.run_id, fc.run_as, fc.custom_tags, r.cnt - 1 AS repairs,
      {_dbl('fc.list_cost')} AS repair_list_cost, {_dbl('fc.effective_cost')} AS repair_effective_cost,
      CASE WHEN s.period_end_time IS NOT NULL THEN CAST((epoch_us(s.period_end_time) - epoch_us(r.first_end)) // 1000000 AS BIGINT) END
        AS repair_time_seconds
    FROM (SELECT workspace_id, job_id, run_id, COUNT(*) AS cnt, MIN(period_end_time) AS first_end
          FROM job_run_timeline WHERE result_state IS NOT NULL AND workspace_id IS NOT NULL AND job_id IS NOT NULL AND run_id IS NOT NULL
          GROUP BY workspace_id, job_id, run_id HAVING COUNT(*) > 1) r
    LEFT JOIN (SELECT workspace_id, job_id, run_id, MAX(period_end_time) AS period_end_time
               FROM job_run_timeline WHERE result_state = 'SUCCEEDED' GROUP BY workspace_id, job_id, run_id) s
      USING (workspace_id, job_id, run_id)
    LEFT JOIN latest_jobs lj USING (workspace_id, job_id)
    LEFT JOIN (SELECT workspace_id, job_id, run_id, MIN(run_as) AS run_as, arg_min(tags_txt, tags_key) AS custom_tags,
                 SUM(status_list_cost) AS list_cost, SUM(status_effective_cost) AS effective_cost
               FROM status_cost WHERE result_state <> 'SUCCEEDED' GROUP BY workspace_id, job_id, run_id) fc
      USING (workspace_id, job_id, run_id)""",
        "workspace_spend_alerts": f"""
    SELECT workspace_id, {_spend_alert_cols(_dbl)} FROM priced_c WHERE {SERVERLESS_ALERT_FILTER} GROUP BY workspace_id""",
        "user_spend_alerts": f"""
    SELECT run_as, {_spend_alert_cols(_dbl)} FROM priced_c WHERE {SERVERLESS_ALERT_FILTER} GROUP BY run_as""",
        "job_spend_alerts": f"""
    SELECT workspace_id, job_id, {_dbl('SUM(list_cost)')} AS list_cost, {_dbl('SUM(effective_cost)')} AS effective_cost
    FROM priced_c WHERE sku_name LIKE '%SERVERLESS%' AND billing_origin_product IN ('JOBS') AND usage_date >= {D} - INTERVAL 30 DAY
    GROUP BY workspace_id, job_id""",
        "serverless_notebook_spend": f"""
    SELECT notebook_id, notebook_path, run_as, {DBU_COLS} FROM priced_c
    WHERE notebook_id IS NOT NULL AND billing_origin_product = 'INTERACTIVE' AND is_serverless AND usage_unit = 'DBU'
      AND usage_date >= {D} - INTERVAL 30 DAY
    GROUP BY notebook_id, notebook_path, run_as""",
        "serverless_job_spend": f"""
    SELECT job_id, job_name, {DBU_COLS} FROM priced_c
    WHERE job_id IS NOT NULL AND usage_unit = 'DBU' AND usage_date >= {D} - INTERVAL 30 DAY AND sku_name LIKE '%JOBS_SERVERLESS_COMPUTE%'
    GROUP BY job_id, job_name""",
        "user_serverless_consumption": f"""
    SELECT job_id, job_name, notebook_id, notebook_path, run_as, {DBU_COLS} FROM priced_c WHERE {SERVERLESS_DBU_FILTER}
    GROUP BY ALL""",
        "serverless_consumption_by_tag": f"""
    SELECT job_id, job_name, notebook_id, notebook_path, tags_txt AS custom_tags, {DBU_COLS}{tm2} FROM priced_c
    WHERE {SERVERLESS_DBU_FILTER} GROUP BY job_id, job_name, notebook_id, notebook_path, tags_txt""",
        "model_serving_costs": f"""
    SELECT u.workspace_id, se.endpoint_name, se.endpoint_id, se.created_by, se.served_entity_name, se.entity_type,
      se.custom_model_config, se.external_model_config, MAX(u.usage_date) AS last_usage_date, arg_min(u.tags_txt, u.tags_key) AS custom_tags{tm3},
      {_dbl('SUM(u.list_cost)')} AS total_list_cost, {_dbl('SUM(u.effective_cost)')} AS total_effective_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 7 DAY THEN u.list_cost ELSE 0 END)')} AS t7d_list_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 7 DAY THEN u.effective_cost ELSE 0 END)')} AS t7d_effective_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 14 DAY THEN u.list_cost ELSE 0 END)')} AS t14d_list_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 14 DAY THEN u.effective_cost ELSE 0 END)')} AS t14d_effective_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 30 DAY THEN u.list_cost ELSE 0 END)')} AS t30d_list_cost,
      {_dbl(f'SUM(CASE WHEN u.usage_date >= {D} - INTERVAL 30 DAY THEN u.effective_cost ELSE 0 END)')} AS t30d_effective_cost
    FROM priced_p u JOIN served_entities se ON u.endpoint_name = se.endpoint_name AND u.account_id = se.account_id
    WHERE u.sku_name LIKE '%SERVERLESS_REAL_TIME_INFERENCE%' AND u.usage_quantity IS NOT NULL AND u.effective_price IS NOT NULL
      AND se.endpoint_name IS NOT NULL AND u.usage_date >= {D} - INTERVAL 30 DAY
    GROUP BY ALL""",
        "batch_inference_costs": f"""
    SELECT workspace_id, usage_date, run_as, tags_txt AS custom_tags, endpoint_name,
      {_dbl('SUM(list_cost)')} AS total_list_cost, {_dbl('SUM(effective_cost)')} AS total_effective_cost
    FROM priced_p WHERE billing_origin_product = 'MODEL_SERVING' AND offering_type = 'BATCH_INFERENCE'
      AND usage_date >= {D} - INTERVAL 30 DAY
    GROUP BY workspace_id, usage_date, run_as, tags_txt, endpoint_name""",
    }


def _ident(x: str) -> str:
    return x


def _as_double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


VIEWS = _views(_as_double, raw=False)
# Views kept in exact decimals (plus their tag map) for the reports built on top of them.
VIEW_CTES = {f"v_{k}": v for k, v in _views(_ident, raw=True).items()}

_EMPTY_MAP = "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))"
REQUIRED = ["environment", "team", "owner"]
_REQ_LIST = "[" + ", ".join(f"'{t}'" for t in REQUIRED) + "]"

RESOURCE_CTES = {
    "resources": f"""
SELECT resource_type, resource_id, resource_name, state, tags_map, cluster_size, creator_user_name, taggable,
  CAST(cardinality(tags_map) AS INTEGER) AS tag_count,
  {tags_txt('tags_map')} AS tags_txt FROM (
  SELECT 'cluster' AS resource_type, CAST(c_custkey AS VARCHAR) AS resource_id, c_name AS resource_name,
    CASE WHEN c_custkey % 9 = 0 THEN 'unknown' ELSE 'RUNNING' END AS state,
    COALESCE({json_map('''CASE WHEN c_custkey % 4 = 0 THEN NULL
      WHEN c_custkey % 4 = 1 THEN concat('{"environment":"production","team":"', c_mktsegment, '"}')
      ELSE concat('{"environment":"development","team":"', c_mktsegment, '","owner":"o', CAST(c_custkey % 6 AS VARCHAR), '"}') END''')},
      {_EMPTY_MAP}) AS tags_map, CAST(NULL AS VARCHAR) AS cluster_size, CAST(NULL AS VARCHAR) AS creator_user_name, TRUE AS taggable
  FROM customer
  UNION ALL SELECT 'warehouse', CAST(s_suppkey AS VARCHAR), s_name, 'STOPPED',
    COALESCE({json_map('''CASE WHEN s_suppkey % 2 = 0 THEN '{"environment":"production"}' END''')}, {_EMPTY_MAP}),
    CASE s_suppkey % 3 WHEN 0 THEN 'Small' WHEN 1 THEN 'Large' END, NULL, TRUE FROM supplier
  UNION ALL SELECT 'job', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 10 = 0 THEN 'Unknown' ELSE p_name END, NULL,
    CASE WHEN p_partkey % 10 = 0 THEN {_EMPTY_MAP}
      ELSE {json_map('''concat('{"team":"', p_brand, '","owner":"o', CAST(p_size % 6 AS VARCHAR), '"}')''')} END,
    NULL, 'creator' || CAST(p_size % 7 AS VARCHAR) || '@x.io', p_partkey % 10 <> 0 FROM part
  UNION ALL SELECT 'pipeline', CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 = 4 THEN 'Unknown' ELSE n_name END, 'IDLE',
    {_EMPTY_MAP}, NULL, NULL, n_nationkey % 5 <> 4 FROM nation) r""",
    "tag_requests": """
SELECT resource_type, resource_id FROM resources
UNION ALL SELECT * FROM (VALUES ('cluster', 'missing'), ('warehouse', 'missing'), ('job', 'missing'), ('pipeline', 'missing'),
  ('dashboard', '1')) x""",
    # a getter fails on unknown ids and types; a change also on jobs without settings and pipelines without a spec
    "tag_lookup": """
SELECT q.resource_type, q.resource_id, r.tags_map, r.tags_txt, r.resource_id IS NOT NULL AS found,
  COALESCE(r.taggable, FALSE) AS ok,
  CASE q.resource_type WHEN 'cluster' THEN 'Cluster ' WHEN 'warehouse' THEN 'Warehouse ' WHEN 'job' THEN 'Job '
    WHEN 'pipeline' THEN 'Pipeline ' END || q.resource_id || ' not found' AS missing,
  CASE q.resource_type WHEN 'job' THEN ' or has no settings' WHEN 'pipeline' THEN ' or has no spec' ELSE '' END AS holder,
  CASE WHEN q.resource_type NOT IN ('cluster', 'warehouse', 'job', 'pipeline') THEN 'Unknown resource type: ' || q.resource_type
  END AS unknown
FROM tag_requests q LEFT JOIN resources r ON q.resource_type = r.resource_type AND q.resource_id = r.resource_id""",
    "tag_changed": f"""
SELECT *, {tags_txt('''map_concat(map_from_entries(list_filter(map_entries(tags_map),
    lambda e: e.key NOT IN ('environment', 'reviewed'))), MAP {'environment': 'production', 'reviewed': '2024'})''')} AS merged,
  'environment=production;reviewed=2024' AS replaced,
  {tags_txt('''map_from_entries(list_filter(map_entries(tags_map), lambda e: e.key NOT IN ('environment', 'reviewed')))''')}
  AS removed FROM tag_lookup""",
    "daily_jobs": f"""
SELECT usage_date, workspace_id, job_id, SUM(effective_cost) AS effective_cost FROM priced_c
WHERE billing_origin_product = 'JOBS' AND usage_date >= {AS_OF} - INTERVAL 30 DAY GROUP BY usage_date, workspace_id, job_id""",
    "tag_rows": """
SELECT job_id, job_name, notebook_id, notebook_path, unnest(map_keys(tags_map)) AS tag_key, unnest(map_values(tags_map)) AS tag_value,
  effective_cost, total_dbu FROM v_serverless_consumption_by_tag""",
}


def _top(metric_sql: str, alias: str, frm: str, keys: list[str], k: int, where: str = "TRUE") -> str:
    """Top-k groups by a summed/maxed metric, NULL keys and NULL metrics excluded, ties by keys."""
    key_list = ", ".join(keys)
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in keys)
    if metric_sql.startswith("SUM("):
        metric_sql = f"COALESCE({metric_sql}, 0)"  # a group without values sums up to nothing, and stays
    return f"""SELECT {key_list}, {metric_sql} AS {alias} FROM {frm} WHERE {where} AND {not_null} GROUP BY {key_list}
HAVING {metric_sql} IS NOT NULL ORDER BY {alias} DESC, {order} LIMIT {k}"""


def _cast_money(body: str, cols: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)}) FROM ({body}) q"


def _mean(c: str) -> str:
    return f"CAST(SUM({c}) AS DOUBLE) / COUNT({c})"


def _display(name: str, job: str) -> str:
    return f"CASE WHEN {name} IS NULL OR length(trim({name})) = 0 THEN 'Job ID: ' || {job} ELSE {name} END"


def _currency(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {v} IS NULL THEN '$0.00' ELSE '$' || format('{{:,.2f}}', {v}) END"


J1_COLS = "name, job_id, workspace_id, runs, run_as, list_cost, effective_cost, custom_tags, last_seen_date"

OPS = {
    "c1_price_join_containment": """
SELECT record_id, price_start_time, CAST(list_cost AS DOUBLE) AS list_cost, CAST(effective_cost AS DOUBLE) AS effective_cost
FROM priced_c""",
    "c2_price_join_point": """
SELECT record_id, price_start_time, CAST(list_cost AS DOUBLE) AS list_cost, CAST(effective_cost AS DOUBLE) AS effective_cost
FROM priced_p""",
    "c3_timeline_hour_join": """
SELECT u.record_id, t.slice_id, t.result_state FROM usage u
JOIN job_run_timeline t ON u.workspace_id = t.workspace_id AND u.job_id = t.job_id AND u.job_run_id = t.run_id
  AND u.usage_start_time >= date_trunc('hour', t.period_start_time)
  AND u.usage_start_time < date_trunc('hour', t.period_end_time) + INTERVAL 1 HOUR""",
    "c10_served_entity_join": """
SELECT u.record_id, se.served_entity_name, se.entity_type FROM usage u
JOIN served_entities se ON u.endpoint_name = se.endpoint_name AND u.account_id = se.account_id""",
    "f1_latest_job_version": """
SELECT workspace_id, job_id, name, change_time FROM jobs
QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC NULLS LAST, name DESC NULLS LAST) = 1""",
    "f4_status_cost_attribution": """
SELECT record_id, slice_id, result_state, CAST(status_list_cost AS DOUBLE) AS status_list_cost,
  CAST(status_effective_cost AS DOUBLE) AS status_effective_cost FROM status_cost""",
    "i7_parse_tags": f"""
SELECT event_id, {tags_txt(f"COALESCE(TRY_CAST(TRY_CAST(props AS JSON) AS MAP(VARCHAR, VARCHAR)), {_EMPTY_MAP})")} AS tags
FROM events""",
    "a6_read_view": _cast_money(f"""
SELECT {J1_COLS} FROM v_most_expensive_jobs WHERE workspace_id IN ('1', '3')
ORDER BY effective_cost DESC NULLS LAST, workspace_id ASC NULLS FIRST, job_id ASC NULLS FIRST LIMIT 50""",
                                ["list_cost", "effective_cost"]),
    # ---- dashboard reports
    "k1_filter_jobs": _cast_money(f"""
SELECT {J1_COLS} FROM v_most_expensive_jobs WHERE workspace_id IN ('0', '1', '2') AND tags_map['env'] IN ('prod')""",
                                  ["list_cost", "effective_cost"]),
    "k2_job_metrics": f"""
SELECT COUNT(*) AS total_jobs, CAST(SUM(effective_cost) AS DOUBLE) AS total_cost, {_mean('effective_cost')} AS avg_cost,
  CAST(SUM(runs) AS BIGINT) AS total_runs FROM v_most_expensive_jobs""",
    "k3_top_jobs_by_cost": f"""
SELECT {_display('name', 'job_id')} AS display_name, workspace_id, job_id, CAST(effective_cost AS DOUBLE) AS effective_cost
FROM v_most_expensive_jobs WHERE effective_cost IS NOT NULL
ORDER BY v_most_expensive_jobs.effective_cost DESC, workspace_id ASC NULLS FIRST, job_id ASC NULLS FIRST LIMIT 25""",
    "k4_top_users_by_job_cost": _cast_money(_top("SUM(effective_cost)", "effective_cost", "v_most_expensive_jobs",
                                                 ["run_as"], 25), ["effective_cost"]),
    "k5_top_jobs_by_runs": f"""
SELECT job_id, name, runs, {_display('name', 'job_id')} AS display_name FROM (
{_top("MAX(runs)", "runs", "v_most_expensive_jobs", ["job_id", "name"], 25)}) q""",
    "k6_run_metrics": f"""
SELECT COUNT(*) AS total_runs, CAST(SUM(effective_cost) AS DOUBLE) AS total_cost, {_mean('effective_cost')} AS avg_cost,
  COUNT(DISTINCT job_id) AS unique_jobs FROM v_most_expensive_job_runs""",
    "k7_top_runs_by_cost": """
SELECT CASE WHEN name IS NULL OR length(trim(name)) = 0 THEN 'Run ' || run_id ELSE substring(name, 1, 20) || '...' END
  AS display_label, workspace_id, job_id, run_id, CAST(effective_cost AS DOUBLE) AS effective_cost
FROM v_most_expensive_job_runs WHERE effective_cost IS NOT NULL
ORDER BY v_most_expensive_job_runs.effective_cost DESC, workspace_id ASC NULLS FIRST, job_id ASC NULLS FIRST,
  run_id ASC NULLS FIRST LIMIT 25""",
    "k7_top_users_by_run_cost": _cast_money(_top("SUM(effective_cost)", "effective_cost", "v_most_expensive_job_runs",
                                                 ["run_as"], 25), ["effective_cost"]),
    "k8_top_jobs_by_run_count": """
SELECT job_id, run_count, CAST(total_cost AS DOUBLE) AS total_cost FROM (
  SELECT job_id, COUNT(run_id) AS run_count, SUM(effective_cost) AS total_cost FROM v_most_expensive_job_runs
  WHERE job_id IS NOT NULL GROUP BY job_id) q
ORDER BY run_count DESC, job_id ASC NULLS FIRST LIMIT 25""",
    "k9_trend_cards": """
SELECT CAST(SUM(CASE WHEN usage_date >= m - INTERVAL 7 DAY THEN effective_cost END) AS DOUBLE) AS t7d_cost,
  CAST(SUM(CASE WHEN usage_date >= m - INTERVAL 14 DAY THEN effective_cost END) AS DOUBLE) AS t14d_cost,
  CAST(SUM(CASE WHEN usage_date >= m - INTERVAL 30 DAY THEN effective_cost END) AS DOUBLE) AS t30d_cost
FROM daily_jobs, (SELECT MAX(usage_date) AS m FROM daily_jobs) mx""",
    "k10_daily_cost": """
SELECT usage_date, CAST(SUM(effective_cost) AS DOUBLE) AS effective_cost FROM daily_jobs WHERE usage_date IS NOT NULL
GROUP BY usage_date""",
    "k11_top_trend_jobs": _cast_money(_top("SUM(effective_cost)", "effective_cost", "daily_jobs", ["job_id"], 25),
                                      ["effective_cost"]),
    "k12_top_growth_jobs": _cast_money(_top("SUM(Last7DayGrowth)", "Last7DayGrowth", "v_job_spend_trend",
                                            ["job_id"], 25), ["Last7DayGrowth"]),
    "k13_failure_metrics": f"""
SELECT COUNT(*) AS total_rows, CAST(SUM(failure_effective_cost) AS DOUBLE) AS total_failure_cost,
  COUNT(DISTINCT job_id) AS unique_jobs, {_mean('failure_effective_cost')} AS avg_failure_cost FROM v_failed_jobs_analysis""",
    "k14_most_failures": f"""
SELECT job_id, CAST(failures AS BIGINT) AS failures FROM (
{_top('SUM(failures)', 'failures', 'v_failed_jobs_analysis', ['job_id'], 25)}) q""",
    "k14_top_failure_cost": _cast_money(_top("SUM(failure_effective_cost)", "failure_effective_cost",
                                             "v_failed_jobs_analysis", ["job_id"], 25), ["failure_effective_cost"]),
    "k15_serverless_job_metrics": f"""
SELECT COUNT(*) AS total_jobs, CAST(SUM(effective_cost) AS DOUBLE) AS total_cost, CAST(SUM(total_dbu) AS DOUBLE) AS total_dbu,
  {_mean('effective_cost')} AS avg_cost FROM v_serverless_job_spend""",
    "k15_top_serverless_jobs": f"""
SELECT {_display('job_name', 'job_id')} AS display_name, job_id, job_name, CAST(effective_cost AS DOUBLE) AS effective_cost
FROM v_serverless_job_spend WHERE effective_cost IS NOT NULL
ORDER BY v_serverless_job_spend.effective_cost DESC, job_id ASC NULLS FIRST, job_name ASC NULLS FIRST LIMIT 25""",
    "k16_notebook_metrics": f"""
SELECT COUNT(*) AS total_notebooks, CAST(SUM(effective_cost) AS DOUBLE) AS total_cost,
  CAST(SUM(total_dbu) AS DOUBLE) AS total_dbu, {_mean('effective_cost')} AS avg_cost FROM v_serverless_notebook_spend""",
    "k16_top_notebook_users": _cast_money(_top("SUM(effective_cost)", "effective_cost", "v_serverless_notebook_spend",
                                               ["run_as"], 25), ["effective_cost"]),
    "k17_unpack_tags": """
SELECT job_id, job_name, notebook_id, notebook_path, tag_key, tag_value, CAST(effective_cost AS DOUBLE) AS effective_cost,
  CAST(total_dbu AS DOUBLE) AS total_dbu FROM tag_rows""",
    "k18_top_tag_keys": _cast_money(_top("SUM(effective_cost)", "effective_cost", "tag_rows", ["tag_key"], 25),
                                    ["effective_cost"]),
    "k18_top_tag_values": _cast_money(_top("SUM(effective_cost)", "effective_cost", "tag_rows", ["tag_value"], 25,
                                           "tag_key = 'team'"), ["effective_cost"]),
    "k19_serving_metrics": f"""
SELECT COUNT(DISTINCT endpoint_name) AS total_endpoints, CAST(SUM(total_effective_cost) AS DOUBLE) AS total_cost,
  {_mean('total_effective_cost')} AS avg_cost, CAST(SUM(t7d_effective_cost) AS DOUBLE) AS t7d_cost FROM v_model_serving_costs""",
    "k19_filter_serving": _cast_money("""
SELECT workspace_id, endpoint_name, endpoint_id, created_by, served_entity_name, entity_type, custom_model_config,
  external_model_config, last_usage_date, custom_tags, total_list_cost, total_effective_cost, t7d_list_cost,
  t7d_effective_cost, t14d_list_cost, t14d_effective_cost, t30d_list_cost, t30d_effective_cost
FROM v_model_serving_costs
WHERE endpoint_name IN ('ep-1', 'ep-2') AND created_by IN ('owner0@x.io', 'owner1@x.io') AND tags_map['env'] IN ('prod')""",
                                      ["total_list_cost", "total_effective_cost", "t7d_list_cost", "t7d_effective_cost",
                                       "t14d_list_cost", "t14d_effective_cost", "t30d_list_cost", "t30d_effective_cost"]),
    "k19_cost_by_entity_type": """
SELECT entity_type, CAST(SUM(total_effective_cost) AS DOUBLE) AS total_effective_cost FROM v_model_serving_costs
WHERE entity_type IS NOT NULL GROUP BY entity_type""",
    "k19_top_endpoints": _cast_money(_top("SUM(total_effective_cost)", "total_effective_cost", "v_model_serving_costs",
                                          ["endpoint_name"], 10), ["total_effective_cost"]),
    "k19_top_served_entities": """
SELECT workspace_id, endpoint_name, endpoint_id, created_by, served_entity_name, entity_type,
  CAST(total_effective_cost AS DOUBLE) AS total_effective_cost FROM v_model_serving_costs WHERE total_effective_cost IS NOT NULL
ORDER BY v_model_serving_costs.total_effective_cost DESC, workspace_id ASC NULLS FIRST, endpoint_name ASC NULLS FIRST,
  endpoint_id ASC NULLS FIRST, created_by ASC NULLS FIRST, served_entity_name ASC NULLS FIRST, entity_type ASC NULLS FIRST
LIMIT 25""",
    "k20_batch_metrics": f"""
SELECT COUNT(*) AS total_entries, CAST(SUM(total_effective_cost) AS DOUBLE) AS total_cost,
  {_mean('total_effective_cost')} AS avg_cost FROM v_batch_inference_costs""",
    "k20_top_batch_users": _cast_money(_top("SUM(total_effective_cost)", "total_effective_cost", "v_batch_inference_costs",
                                            ["run_as"], 25), ["total_effective_cost"]),
    "k20_daily_endpoint_cost": """
SELECT usage_date, endpoint_name, CAST(SUM(total_effective_cost) AS DOUBLE) AS total_effective_cost
FROM v_batch_inference_costs
WHERE usage_date >= (SELECT MAX(usage_date) FROM v_batch_inference_costs) - INTERVAL 30 DAY
  AND usage_date IS NOT NULL AND endpoint_name IS NOT NULL
GROUP BY usage_date, endpoint_name""",
    "k21_user_metrics": f"""
SELECT COUNT(DISTINCT run_as) AS unique_users, CAST(SUM(effective_cost) AS DOUBLE) AS total_cost,
  CAST(SUM(total_dbu) AS DOUBLE) AS total_dbu,
  (SELECT {_mean('g')} FROM (SELECT SUM(effective_cost) AS g FROM v_user_serverless_consumption
     WHERE run_as IS NOT NULL GROUP BY run_as)) AS avg_cost_per_user
FROM v_user_serverless_consumption""",
    "k21_top_users": _cast_money(_top("SUM(effective_cost)", "effective_cost", "v_user_serverless_consumption",
                                      ["run_as"], 25), ["effective_cost"]),
    "k21_jobs_vs_notebooks": """
SELECT 'Jobs' AS type, CAST(SUM(CASE WHEN job_id IS NOT NULL THEN effective_cost END) AS DOUBLE) AS cost
FROM v_user_serverless_consumption
UNION ALL
SELECT 'Notebooks', CAST(SUM(CASE WHEN notebook_id IS NOT NULL THEN effective_cost END) AS DOUBLE)
FROM v_user_serverless_consumption""",
    "k21_top_users_t7d": _cast_money(_top("SUM(t7d_effective_cost)", "t7d_effective_cost", "v_user_spend_alerts",
                                          ["run_as"], 25), ["t7d_effective_cost"]),
    "k21_top_users_t14d": _cast_money(_top("SUM(t14d_effective_cost)", "t14d_effective_cost", "v_user_spend_alerts",
                                           ["run_as"], 25), ["t14d_effective_cost"]),
    "k21_top_users_total": _cast_money(_top("SUM(effective_cost)", "effective_cost", "v_user_spend_alerts",
                                            ["run_as"], 25), ["effective_cost"]),
    "k23_job_name_options": """
SELECT DISTINCT name FROM v_most_expensive_jobs WHERE name IS NOT NULL""",
    "k23_tag_value_options": """
SELECT DISTINCT tags_map['team'] AS tag_value FROM v_most_expensive_jobs WHERE tags_map['team'] IS NOT NULL""",
    "k23_tag_key_options": """
SELECT DISTINCT unnest(map_keys(tags_map)) AS tag_key FROM v_most_expensive_jobs""",
    "k23_user_options": """
SELECT DISTINCT run_as FROM v_most_expensive_jobs WHERE run_as IS NOT NULL""",
    "k24_detail_table": f"""
SELECT name, job_id, workspace_id, runs, run_as, {_currency('list_cost')} AS list_cost,
  {_currency('effective_cost')} AS effective_cost, custom_tags, last_seen_date,
  format('Showing {{}} of {{}} rows', least(n, 100), n) AS caption
FROM (SELECT *, COUNT(*) OVER () AS n FROM v_most_expensive_jobs) q
ORDER BY q.effective_cost DESC NULLS LAST, workspace_id ASC NULLS FIRST, job_id ASC NULLS FIRST LIMIT 100""",
    "g4_safe_top_k": """
SELECT o_orderkey, TRY_CAST(price AS DOUBLE) AS price FROM (SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders) o
WHERE TRY_CAST(price AS DOUBLE) IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 25""",
    "k22_coerce_numeric": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) END AS price FROM orders""",
    "i7_parse_tag_text": """
SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 3) THEN 'b=' || p_brand ELSE '' END AS tags FROM part""",
    "i8_merge_tags": """
SELECT resource_type, resource_id, merged AS "merge", replaced AS "replace", removed AS "remove" FROM tag_changed
WHERE found""",
    "i11_display_names": """
SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 'Job ID: ' || CAST(p_partkey AS VARCHAR) ELSE n END AS display,
  CASE WHEN p_partkey % 6 < 3 THEN 'Run ' || CAST(p_partkey AS VARCHAR) ELSE substr(n, 1, 20) || '...' END AS label
FROM (SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || ' ' || chr(10) WHEN 2 THEN '' WHEN 3 THEN chr(9) || p_name ELSE p_name END) AS n FROM part) p""",
    "i13_number_text": f"""
SELECT l_orderkey, l_linenumber, {_currency('v')} AS total_cost,
  CASE WHEN v IS NULL THEN '0' WHEN v >= 1000000 THEN format('{{:.1f}}M', v / 1000000) WHEN v >= 1000 THEN format('{{:.1f}}K', v / 1000)
    ELSE format('{{:.1f}}', v) END AS large
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 <> 5 THEN CAST(l_orderkey % 9000 AS DOUBLE) / 8::DOUBLE - 200::DOUBLE
  + CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_extendedprice AS DOUBLE) * 37::DOUBLE ELSE 0::DOUBLE END END AS v FROM lineitem) x""",
    "i15_required_tags": """
SELECT p_partkey, replace(p_name, ' ', ',') AS required FROM part""",
    "i16_clean_pairs": f"""
SELECT p_partkey, {tags_txt("map_from_entries([('kind', p_type), (p_brand, p_name)])")} AS tags FROM part""",
    "k6_filter_runs": _cast_money("""
SELECT workspace_id, name, job_id, run_id, run_as, list_cost, effective_cost, custom_tags, last_seen_date
FROM v_most_expensive_job_runs WHERE workspace_id IN ('1', '2') AND list_contains(string_split(custom_tags, ';'), 'env=prod')""",
                                  ["list_cost", "effective_cost"]),
    "k23_job_id_options": "SELECT DISTINCT job_id FROM v_most_expensive_jobs WHERE job_id IS NOT NULL",
    "k23_workspace_options": "SELECT DISTINCT workspace_id FROM v_most_expensive_jobs WHERE workspace_id IS NOT NULL",
    "k23_endpoint_options": "SELECT DISTINCT endpoint_name FROM v_model_serving_costs WHERE endpoint_name IS NOT NULL",
    "k23_created_by_options": "SELECT DISTINCT created_by FROM v_model_serving_costs WHERE created_by IS NOT NULL",
    "k23_jobs_page_options": " UNION ".join(
        [f"SELECT '{c}' AS list_name, CAST(NULL AS VARCHAR) AS tag_key, CAST({c} AS VARCHAR) AS value FROM v_most_expensive_jobs "
         f"WHERE {c} IS NOT NULL" for c in ("run_as", "name", "job_id", "workspace_id")]
        + ["SELECT 'tag_key', NULL, unnest(map_keys(tags_map)) FROM v_most_expensive_jobs",
           "SELECT 'tag_value', e.key, e.value FROM (SELECT unnest(map_entries(tags_map)) AS e FROM v_most_expensive_jobs) t "
           "WHERE e.value IS NOT NULL"]),
    "k23_serving_page_options": " UNION ".join(
        f"SELECT '{c}' AS list_name, CAST(NULL AS VARCHAR) AS tag_key, CAST({c} AS VARCHAR) AS value FROM v_model_serving_costs "
        f"WHERE {c} IS NOT NULL" for c in ("endpoint_name", "created_by", "served_entity_name", "workspace_id")),
    # ---- resource tagging
    "l1_resource_inventory": """
SELECT resource_type, resource_id, resource_name, state, tags_txt AS tags, cluster_size, creator_user_name, taggable, tag_count
FROM resources""",
    "l2_list_tags": """
SELECT resource_type, resource_id, found AS success, CASE WHEN found THEN tags_txt END AS tags,
  CASE WHEN found THEN CAST(cardinality(tags_map) AS INTEGER) END AS tag_count,
  CASE WHEN NOT found THEN COALESCE(unknown, missing) END AS error FROM tag_lookup""",
    "l3_update_tags": """
SELECT resource_type, resource_id, ok AS success, CASE WHEN ok THEN tags_txt END AS previous_tags,
  CASE WHEN ok THEN merged END AS new_tags, CASE WHEN ok THEN 'merge' END AS operation,
  CASE WHEN NOT ok THEN COALESCE(unknown, missing || holder) END AS error FROM tag_changed WHERE resource_type = 'warehouse' AND resource_id = '2'""",
    "l4_bulk_update_tags": """
SELECT resource_type, resource_id, ok AS success, CASE WHEN ok THEN tags_txt END AS previous_tags,
  CASE WHEN ok THEN merged END AS new_tags, CASE WHEN ok THEN 'merge' END AS operation,
  CASE WHEN NOT ok THEN COALESCE(unknown, missing || holder) END AS error FROM tag_changed""",
    "l4_bulk_replace_tags": """
SELECT resource_type, resource_id, ok AS success, CASE WHEN ok THEN tags_txt END AS previous_tags,
  CASE WHEN ok THEN replaced END AS new_tags, CASE WHEN ok THEN 'replace' END AS operation,
  CASE WHEN NOT ok THEN COALESCE(unknown, missing || holder) END AS error FROM tag_changed""",
    "l4_bulk_remove_tags": """
SELECT resource_type, resource_id, ok AS success, CASE WHEN ok THEN tags_txt END AS previous_tags,
  CASE WHEN ok THEN removed END AS new_tags, CASE WHEN ok THEN 'remove' END AS operation,
  CASE WHEN NOT ok THEN COALESCE(unknown, missing || holder) END AS error FROM tag_changed""",
    "l5_find_by_tag_key": """
SELECT resource_type, resource_id, resource_name, tags_map['team'] AS tag_value, tags_txt AS all_tags FROM resources
WHERE map_contains(tags_map, 'team')""",
    "l5_find_by_tag_value": """
SELECT resource_type, resource_id, resource_name, tags_map['environment'] AS tag_value, tags_txt AS all_tags FROM resources
WHERE map_contains(tags_map, 'environment') AND tags_map['environment'] = 'production'""",
    "l6_compliance_details": f"""
SELECT resource_type, resource_id, COALESCE(resource_name, 'Unknown') AS resource_name,
  array_to_string(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k)), ',') AS missing_tags,
  tags_txt AS current_tags
FROM resources WHERE len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) > 0""",
    "l7_compliance_by_type": f"""
SELECT k.resource_type, COALESCE(total, 0) AS total, COALESCE(compliant, 0) AS compliant,
  COALESCE(total, 0) - COALESCE(compliant, 0) AS non_compliant,
  CASE WHEN COALESCE(total, 0) > 0 THEN CAST(compliant AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0.0 END
    AS compliance_percentage
FROM (VALUES ('cluster'), ('warehouse'), ('job'), ('pipeline')) k(resource_type)
LEFT JOIN (SELECT resource_type, COUNT(*) AS total,
             CAST(SUM(CASE WHEN len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) = 0 THEN 1 ELSE 0 END) AS BIGINT)
               AS compliant
           FROM resources GROUP BY resource_type) c USING (resource_type)""",
    "l8_compliance_summary": f"""
SELECT total AS total_resources, compliant AS compliant_resources, total - compliant AS non_compliant_resources,
  CASE WHEN total > 0 THEN CAST(compliant AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0.0 END AS compliance_percentage
FROM (SELECT COUNT(*) AS total,
        CAST(COALESCE(SUM(CASE WHEN len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) = 0 THEN 1 ELSE 0 END), 0) AS BIGINT)
          AS compliant FROM resources) s""",
    "e16_compliance_rollup": f"""
SELECT resource_type, COUNT(*) AS total,
  CAST(SUM(CASE WHEN len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) = 0 THEN 1 ELSE 0 END) AS BIGINT)
    AS compliant,
  COUNT(*) - CAST(SUM(CASE WHEN len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) = 0 THEN 1 ELSE 0 END) AS BIGINT)
    AS non_compliant,
  CASE WHEN COUNT(*) > 0 THEN CAST(SUM(CASE WHEN len(list_filter({_REQ_LIST}, lambda k: NOT map_contains(tags_map, k))) = 0
    THEN 1 ELSE 0 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100 ELSE 0.0 END AS compliance_percentage
FROM resources GROUP BY ROLLUP (resource_type)""",
    "l9_untagged": """
SELECT resource_type, resource_id, resource_name, state, tags_txt AS tags, cluster_size, creator_user_name, taggable, tag_count FROM resources WHERE tag_count = 0""",
    "l9_untagged_clusters": """
SELECT resource_type, resource_id, resource_name, state, tags_txt AS tags, cluster_size, creator_user_name, taggable, tag_count FROM resources
WHERE tag_count = 0 AND resource_type = 'cluster'""",
    "l10_resource_counts": """
SELECT resource_type, COUNT(*) AS resource_count FROM resources GROUP BY resource_type""",
}


def _referenced(body: str, names) -> set[str]:
    return {n for n in names if re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", body)}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with every CTE it references, directly or through other CTEs."""
    ctes = {**FIXTURES, **VIEW_CTES, **RESOURCE_CTES}
    need: set[str] = set()
    todo = list(_referenced(body, ctes))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo += [m for m in _referenced(ctes[n], ctes) if m != n]
    ordered = _topological([n for n in ctes if n in need], ctes)
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in ordered) + "\n" + body.strip()


def _topological(names: list[str], ctes: dict[str, str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for m in sorted(_referenced(ctes[n], names) - {n}):
            visit(m)
        out.append(n)

    for n in names:
        visit(n)
    return out


def all_oracle_sql() -> dict[str, str]:
    bodies = {**VIEWS, **OPS}
    return {name: with_fixtures(body) for name, body in bodies.items()}
