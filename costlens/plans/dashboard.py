"""Dashboard reports over the cost views.

Each function takes a view DataFrame and returns a small result DataFrame:
one-row metrics (computed in one aggregate pass), top-k lists (distributed
``TakeOrderedAndProject``) or grouped series.  Group keys that are NULL are
dropped before grouping, as the dashboard's grouping does.  Nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CAPTION, DETAIL_ROWS, LOOKBACK_DAYS, TOP_ENDPOINTS, TOP_K
from ..functions.text import display_name, format_money_columns, run_label
from ..operators.filters import filter_in, filter_tag, since_latest
from ..operators.metrics import mean, mean_of_group_sums, summary
from ..operators.pricing import priced_usage
from ..operators.topk import capped, top_groups, top_k
from ..session import ensure_checkpoint_dir
from .jobs import jobs_usage

TOP = TOP_K


# ---- K1 / K6 / K19: filters -------------------------------------------------------------

def filter_view(df: DataFrame, run_as=None, job_ids=None, names=None, workspaces=None, endpoints=None,
                created_by=None, job_names=None, tag_key: str | None = None,
                tag_values: Sequence[str] | None = None) -> DataFrame:
    """Membership filters (empty selection = all) and the tag filter."""
    sel = {"run_as": run_as, "job_id": job_ids, "name": names, "workspace_id": workspaces,
           "endpoint_name": endpoints, "created_by": created_by, "job_name": job_names}
    return filter_tag(filter_in(df, sel), tag_key, tag_values)


# ---- jobs pages (J1, J2) ----------------------------------------------------------------

def job_metrics(jobs_view: DataFrame) -> DataFrame:
    """K2: jobs, total cost, mean cost per job, total runs."""
    return summary(jobs_view, [F.count(F.lit(1)).alias("total_jobs"),
                               F.sum("effective_cost").alias("total_cost"),
                               mean("effective_cost").alias("avg_cost"),
                               F.sum("runs").alias("total_runs")])


def top_jobs_by_cost(jobs_view: DataFrame, k: int = TOP) -> DataFrame:
    """K3: the k most expensive jobs with a display name."""
    top = top_k(jobs_view, k, "effective_cost", ["workspace_id", "job_id"])
    return top.select(display_name("name", "job_id").alias("display_name"), "workspace_id", "job_id",
                      "effective_cost")


def top_users_by_cost(view: DataFrame, k: int = TOP, cost: str = "effective_cost") -> DataFrame:
    """Users by summed cost (NULL user dropped)."""
    return top_groups(view, k, "run_as", cost)


def top_jobs_by_runs(jobs_view: DataFrame, k: int = TOP) -> DataFrame:
    """K5: jobs with the most runs; one pick of ``runs`` per (job_id, name)."""
    top = top_groups(jobs_view, k, ["job_id", "name"], "runs", agg="max")
    return top.select("job_id", "name", "runs", display_name("name", "job_id").alias("display_name"))


def run_metrics(runs_view: DataFrame) -> DataFrame:
    """K6: runs, total cost, mean cost per run, distinct jobs."""
    return summary(runs_view, [F.count(F.lit(1)).alias("total_runs"),
                               F.sum("effective_cost").alias("total_cost"),
                               mean("effective_cost").alias("avg_cost"),
                               F.countDistinct("job_id").alias("unique_jobs")])


def top_runs_by_cost(runs_view: DataFrame, k: int = TOP) -> DataFrame:
    """K7: the k most expensive runs with a short label."""
    top = top_k(runs_view, k, "effective_cost", ["workspace_id", "job_id", "run_id"])
    return top.select(run_label("name", "run_id").alias("display_label"), "workspace_id", "job_id", "run_id",
                      "effective_cost")


def top_jobs_by_run_count(runs_view: DataFrame, k: int = TOP) -> DataFrame:
    """K8: jobs by number of runs, with their total cost."""
    per_job = runs_view.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        F.count("run_id").alias("run_count"), F.sum("effective_cost").alias("total_cost"))
    return top_k(per_job, k, "run_count", ["job_id"])


# ---- trend page --------------------------------------------------------------------------

def daily_job_costs(usage: DataFrame, prices: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Daily effective cost per job (the dated series the trend page needs)."""
    priced = priced_usage(jobs_usage(usage, as_of, lookback_days), prices)
    return priced.groupBy("usage_date", "workspace_id", F.col("usage_metadata.job_id").alias("job_id")).agg(
        F.sum("effective_cost").alias("effective_cost"))


def trend_cards(daily: DataFrame, date_col: str = "usage_date", cost: str = "effective_cost") -> DataFrame:
    """K9: cost of the last 7 / 14 / 30 days counted back from the latest date present."""
    per_day = daily.groupBy(F.col(date_col).alias("day")).agg(F.sum(cost).alias("cost"))
    # one row per day meets in one partition, and the series is read once
    per_day = per_day.withColumn("latest", F.max("day").over(Window.partitionBy()))
    return per_day.agg(*[F.sum(F.when(F.col("day") >= F.date_sub("latest", n), F.col("cost"))).alias(f"t{n}d_cost")
                         for n in (7, 14, 30)])


def daily_cost(daily: DataFrame, date_col: str = "usage_date", cost: str = "effective_cost") -> DataFrame:
    """Cost per day."""
    return daily.where(F.col(date_col).isNotNull()).groupBy(date_col).agg(F.sum(cost).alias(cost))


def top_trend_jobs(daily: DataFrame, k: int = TOP, cost: str = "effective_cost") -> DataFrame:
    """Jobs with the largest total cost over the series."""
    return top_groups(daily, k, "job_id", cost)


def top_growth_jobs(trend_view: DataFrame, k: int = TOP) -> DataFrame:
    """Jobs with the largest week-over-week growth (summed over a job's rows)."""
    return top_groups(trend_view, k, "job_id", "Last7DayGrowth")


# ---- failures page (J4) -----------------------------------------------------------------

def failure_metrics(failed_view: DataFrame) -> DataFrame:
    """Rows, total failure cost, distinct jobs, mean failure cost."""
    return summary(failed_view, [F.count(F.lit(1)).alias("total_rows"),
                                 F.sum("failure_effective_cost").alias("total_failure_cost"),
                                 F.countDistinct("job_id").alias("unique_jobs"),
                                 mean("failure_effective_cost").alias("avg_failure_cost")])


def most_failures(failed_view: DataFrame, k: int = TOP) -> DataFrame:
    """Jobs with the most failures."""
    return top_groups(failed_view, k, "job_id", "failures")


def top_failure_cost(failed_view: DataFrame, k: int = TOP) -> DataFrame:
    """Jobs with the highest failure cost."""
    return top_groups(failed_view, k, "job_id", "failure_effective_cost")


# ---- serverless pages (J9, J10, J12) ------------------------------------------------------

def serverless_job_metrics(job_view: DataFrame) -> DataFrame:
    """Jobs, total cost, total DBUs, mean cost per job."""
    return summary(job_view, [F.count(F.lit(1)).alias("total_jobs"), F.sum("effective_cost").alias("total_cost"),
                              F.sum("total_dbu").alias("total_dbu"), mean("effective_cost").alias("avg_cost")])


def top_serverless_jobs(job_view: DataFrame, k: int = TOP) -> DataFrame:
    """The k most expensive serverless jobs with a display name."""
    top = top_k(job_view, k, "effective_cost", ["job_id", "job_name"])
    return top.select(display_name("job_name", "job_id").alias("display_name"), "job_id", "job_name",
                      "effective_cost")


def notebook_metrics(notebook_view: DataFrame) -> DataFrame:
    """Notebooks (rows), total cost, total DBUs, mean cost."""
    return summary(notebook_view, [F.count(F.lit(1)).alias("total_notebooks"),
                                   F.sum("effective_cost").alias("total_cost"),
                                   F.sum("total_dbu").alias("total_dbu"),
                                   mean("effective_cost").alias("avg_cost")])


def unpack_tags(tag_view: DataFrame, keys: Sequence[str] = ("job_id", "job_name", "notebook_id", "notebook_path"),
                tags_col: str = "custom_tags") -> DataFrame:
    """One row per (row, tag) with the row's cost and DBUs; rows without tags vanish."""
    cols = [c for c in keys if c in tag_view.columns]
    return tag_view.select(*cols, F.explode(F.col(tags_col)).alias("tag_key", "tag_value"),
                           "effective_cost", "total_dbu")


def top_tag_keys(unpacked: DataFrame, k: int = TOP) -> DataFrame:
    """Tag keys by summed cost (a row with n tags counts n times)."""
    return top_groups(unpacked, k, "tag_key", "effective_cost")


def top_tag_values(unpacked: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """Values of one tag key by summed cost."""
    return top_groups(unpacked.where(F.col("tag_key") == key), k, "tag_value", "effective_cost")


# ---- serving pages (J13, J14) -------------------------------------------------------------

def serving_metrics(serving_view: DataFrame) -> DataFrame:
    """Distinct endpoints, total cost, mean cost per row, 7-day cost."""
    return summary(serving_view, [F.countDistinct("endpoint_name").alias("total_endpoints"),
                                  F.sum("total_effective_cost").alias("total_cost"),
                                  mean("total_effective_cost").alias("avg_cost"),
                                  F.sum("t7d_effective_cost").alias("t7d_cost")])


def cost_by_entity_type(serving_view: DataFrame) -> DataFrame:
    """Total cost per entity type."""
    return serving_view.where(F.col("entity_type").isNotNull()).groupBy("entity_type").agg(
        F.sum("total_effective_cost").alias("total_effective_cost"))


def top_endpoints(serving_view: DataFrame, k: int = TOP_ENDPOINTS) -> DataFrame:
    """Endpoints by summed cost."""
    return top_groups(serving_view, k, "endpoint_name", "total_effective_cost")


def top_served_entities(serving_view: DataFrame, k: int = TOP) -> DataFrame:
    """The k most expensive served-entity rows."""
    keys = ["workspace_id", "endpoint_name", "endpoint_id", "created_by", "served_entity_name", "entity_type"]
    return top_k(serving_view, k, "total_effective_cost", keys).select(*keys, "total_effective_cost")


def batch_metrics(batch_view: DataFrame) -> DataFrame:
    """Rows, total cost, mean cost."""
    return summary(batch_view, [F.count(F.lit(1)).alias("total_entries"),
                                F.sum("total_effective_cost").alias("total_cost"),
                                mean("total_effective_cost").alias("avg_cost")])


def daily_endpoint_cost(batch_view: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Cost per day and endpoint over the last ``days`` days before the latest date."""
    per_day = stored(batch_view.where(F.col("usage_date").isNotNull()).groupBy("usage_date", "endpoint_name").agg(
        F.sum("total_effective_cost").alias("total_effective_cost")))
    return since_latest(per_day, "usage_date", days).where(F.col("endpoint_name").isNotNull())


# ---- user pages (J7, J11) ------------------------------------------------------------------

def user_metrics(consumption_view: DataFrame) -> DataFrame:
    """Distinct users, total cost, total DBUs, mean cost per user."""
    totals = summary(consumption_view, [F.countDistinct("run_as").alias("unique_users"),
                                        F.sum("effective_cost").alias("total_cost"),
                                        F.sum("total_dbu").alias("total_dbu")])
    per_user = mean_of_group_sums(consumption_view, "run_as", "effective_cost", "avg_cost_per_user")
    return totals.withColumn("avg_cost_per_user", per_user.scalar())


def jobs_vs_notebooks(consumption_view: DataFrame) -> DataFrame:
    """Cost of rows with a job id and of rows with a notebook id (a row may count in both)."""
    c = F.col("effective_cost")
    sums = consumption_view.agg(F.sum(F.when(F.col("job_id").isNotNull(), c)).alias("Jobs"),
                                F.sum(F.when(F.col("notebook_id").isNotNull(), c)).alias("Notebooks"))
    return sums.select(F.expr("stack(2, 'Jobs', Jobs, 'Notebooks', Notebooks) AS (type, cost)"))


# ---- generic -------------------------------------------------------------------------------

def filter_options(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL values of a column, sorted."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def tag_keys(df: DataFrame, tags_col: str = "custom_tags") -> DataFrame:
    """Distinct tag keys, sorted."""
    return df.select(F.explode(F.map_keys(F.col(tags_col))).alias("tag_key")).distinct().orderBy("tag_key")


def tag_values(df: DataFrame, key: str, tags_col: str = "custom_tags") -> DataFrame:
    """Distinct values of one tag key, sorted."""
    v = F.element_at(F.col(tags_col), F.lit(key))
    return df.where(v.isNotNull()).select(v.alias("tag_value")).distinct().orderBy("tag_value")


def page_options(df: DataFrame, cols: Sequence[str], tags_col: str | None = "custom_tags") -> DataFrame:
    """All option lists of a page in one evaluation of the view.

    Every row gives its (list, tag key, value) triples: one per non-NULL column of
    ``cols``, under ``tag_key`` one per tag key and under ``tag_value`` one per tag.
    Equal triples are merged in the tasks that read the view before they are shuffled.
    Values are text; a tag without a value is in the list of keys only.
    """
    kind = "array<struct<list_name: string, tag_key: string, value: string>>"

    def triple(name: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("list_name"), key.alias("tag_key"), value.alias("value"))

    none = F.lit(None).cast("string")
    lists = [F.array(*(triple(c, none, F.col(c).cast("string")) for c in cols)).cast(kind)]
    if tags_col:
        tags = F.coalesce(F.map_entries(tags_col), F.array().cast("array<struct<key: string, value: string>>"))
        lists += [F.transform(tags, lambda t: triple("tag_key", none, t["key"])).cast(kind),
                  F.transform(tags, lambda t: triple("tag_value", t["key"], t["value"])).cast(kind)]
    found = df.select(F.inline(F.concat(*lists))).where(F.col("value").isNotNull())
    return found.distinct().orderBy("list_name", "tag_key", "value")


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to DOUBLE (unparsable -> NULL); listed columns only."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols if c in df.columns})


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, for reports that read it twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def detail_table(df: DataFrame, sort_col: str, keys: Sequence[str], max_rows: int = DETAIL_ROWS) -> DataFrame:
    """First ``max_rows`` rows by ``sort_col`` descending with money columns as currency
    text, and the ``showing n of N`` caption; count and rows come from one stored ``df``."""
    df = stored(df)
    total = df.select(F.count(F.lit(1))).scalar()
    order = [F.col(sort_col).desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in keys]
    shown = format_money_columns(capped(df, max_rows, order))
    caption = F.format_string(CAPTION, F.least(total, F.lit(max_rows)), total)
    return shown.withColumn("caption", caption)
