"""Runs, jobs, timings and usage as plain tables.

The reference keeps these in process memory and a tracking server; here
they are append-only tables (Parquet) and every report is a DataFrame
aggregation over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import format_cost

# ---- fixed values that must equal the reference's --------------------------
PREPROCESSING_METRICS = [
    "preprocessing_data_cleaning_time",
    "preprocessing_outlier_removal_time",
    "preprocessing_feature_encoding_time",
    "preprocessing_ranked_encoder_time",
    "preprocessing_proximity_encoder_time",
    "preprocessing_cost_of_living_encoder_time",
    "preprocessing_metro_population_encoder_time",
    "preprocessing_date_normalizer_time",
]
# USD per 1M (prompt, completion) tokens, and the per-provider fallback model
PRICES = {
    "openai": {"gpt-4-turbo-preview": (10.0, 30.0), "gpt-4": (30.0, 60.0), "gpt-4-32k": (60.0, 120.0),
               "gpt-3.5-turbo": (0.5, 1.5), "gpt-3.5-turbo-16k": (3.0, 4.0), "gpt-4o": (5.0, 15.0),
               "gpt-4o-mini": (0.15, 0.6)},
    "gemini": {"gemini-pro": (0.5, 1.5), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.3),
               "gemini-ultra": (10.0, 30.0)},
}
DEFAULT_MODEL = {"openai": "gpt-3.5-turbo", "gemini": "gemini-pro"}
DEFAULT_MODEL_TYPE = "XGBoost"
DEFAULT_DATASET = "Unknown"
JOB_COMPLETED_TEXT = "Model trained successfully"
# ---------------------------------------------------------------------------

METRICS_SCHEMA = "metric string, value double"
CALLS_SCHEMA = ("model string, provider string, prompt_tokens long, completion_tokens long, "
                "total_tokens long, latency double, ts timestamp")
RUNS_SCHEMA = "run_id string, start_time timestamp, status string, experiment string"
TAGS_SCHEMA = "run_id string, key string, value string"
RUN_METRICS_SCHEMA = "run_id string, key string, value double, ts timestamp"
JOB_EVENTS_SCHEMA = ("job_id string, ts timestamp, status string, stage string, model string, "
                     "best_round int, best_score double, message string")


# ---- M1-M3 -------------------------------------------------------------------
def metric_stats(metrics: DataFrame, name: str | None = None) -> DataFrame:
    """M1: count, total, mean, min, max per metric (one metric if named)."""
    m = metrics if name is None else metrics.filter(F.col("metric") == name)
    return m.groupBy("metric").agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"),
                                   F.avg("value").alias("mean"), F.min("value").alias("min"),
                                   F.max("value").alias("max"))


def all_metrics(metrics: DataFrame) -> DataFrame:
    """M2: every observation, by metric name."""
    return metrics.select("metric", "value")


def performance_summary(metrics: DataFrame) -> DataFrame:
    """M3: M1 for every metric, flagged when it is a preprocessing metric,
    plus the preprocessing total as a column (one aggregation pass)."""
    stats = metric_stats(metrics).withColumn("is_preprocessing", F.col("metric").isin(*PREPROCESSING_METRICS))
    total = F.sum(F.when(F.col("is_preprocessing"), F.col("total")).otherwise(F.lit(0.0))).over(
        Window.partitionBy(F.lit(1)))
    # the stats frame has one row per metric name: a small, bounded window
    return stats.withColumn("preprocessing_total", total)


def performance_summary_doc(metrics: DataFrame, calls: DataFrame | None = None) -> dict:
    """M3 as the nested document of the reference: timing_metrics (M1 of
    every metric), preprocessing_metrics (the fixed preprocessing names)
    and llm_metrics (M4 over all calls, or None).  Built from two small
    aggregations; the document is metadata-sized."""
    stats = {r["metric"]: {"count": r["count"], "total": r["total"], "mean": r["mean"],
                           "min": r["min"], "max": r["max"]}
             for r in metric_stats(metrics).collect()}
    doc = {"timing_metrics": stats, "llm_metrics": None,
           "preprocessing_metrics": {k: stats[k] for k in PREPROCESSING_METRICS if k in stats}}
    if calls is not None:
        rows = usage_summary(calls, by=[]).collect()
        if rows and rows[0]["call_count"]:
            doc["llm_metrics"] = {k: rows[0][k] for k in rows[0].asDict()}
    return doc


# ---- M4-M7, J7 ----------------------------------------------------------------
def _price(provider: Column, model: Column, idx: int) -> Column:
    keyed = {f"{p}|{m}": v[idx] for p, models in PRICES.items() for m, v in models.items()}
    table = F.create_map(*[x for k, v in keyed.items() for x in (F.lit(k), F.lit(float(v)))])
    prov = F.lower(provider)
    exact = F.try_element_at(table, F.concat(prov, F.lit("|"), F.lower(model)))
    fallback = F.lit(None).cast("double")
    for p, m in DEFAULT_MODEL.items():
        fallback = F.when(prov == p, F.lit(float(PRICES[p][m][idx]))).otherwise(fallback)
    return F.coalesce(exact, fallback)


def call_cost(calls: DataFrame) -> DataFrame:
    """cost = prompt/1e6 * p + completion/1e6 * c.

    Unknown model -> the provider's default model price; unknown provider ->
    0.  The price list is a fixed, tiny table, so it is a map literal in the
    plan (a broadcast join in effect, with no join).  Missing total tokens
    default to prompt + completion.
    """
    known = F.lower(F.col("provider")).isin(*PRICES)
    cost = (F.col("prompt_tokens") / F.lit(1_000_000.0) * _price(F.col("provider"), F.col("model"), 0)
            + F.col("completion_tokens") / F.lit(1_000_000.0) * _price(F.col("provider"), F.col("model"), 1))
    return calls.withColumns({
        "total_tokens": F.coalesce(F.col("total_tokens"), F.col("prompt_tokens") + F.col("completion_tokens")),
        "cost": F.when(known, cost).otherwise(F.lit(0.0)),
    })


def usage_summary(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M4: calls, token sums, cost sum, mean latency over latency > 0 (0 if none)."""
    with_cost = calls if "cost" in calls.columns else call_cost(calls)
    by = ["model", "provider"] if by is None else by
    return with_cost.groupBy(*by).agg(
        F.count(F.lit(1)).alias("call_count"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("total_cost"),
        F.coalesce(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), F.lit(0.0)).alias("avg_latency"))


def cost_label(c: str | Column) -> Column:
    """M6."""
    return format_cost(c)


# ---- M8-M12, J6 -----------------------------------------------------------------
def list_models(runs: DataFrame, tags: DataFrame, metrics: DataFrame, status: str = "FINISHED",
                tag_keys: list[str] | None = None, metric_keys: list[str] | None = None) -> DataFrame:
    """M8/M9: finished runs with ``tags.*`` and ``metrics.*`` pivoted in,
    newest first.  Rows without a run id (corrupt records) are skipped.
    Pivot keys are passed or discovered (metadata-sized distinct)."""
    r = runs.filter(F.col("run_id").isNotNull() & (F.col("status") == status))
    tag_keys = tag_keys or [x[0] for x in tags.select("key").distinct().orderBy("key").collect()]
    metric_keys = metric_keys or [x[0] for x in metrics.select("key").distinct().orderBy("key").collect()]
    # tags and metrics in one shuffle: union them, then conditional aggregates
    long = (tags.select("run_id", "key", F.col("value").alias("s"), F.lit(None).cast("double").alias("d"),
                        F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("is_tag"))
            .unionByName(metrics.select("run_id", "key", F.lit(None).cast("string").alias("s"),
                                        F.col("value").alias("d"), F.col("ts").cast("timestamp").alias("ts"),
                                        F.lit(False).alias("is_tag"))))
    aggs = [F.max_by("s", F.when(F.col("is_tag") & (F.col("key") == k), F.lit(1))).alias(f"tags.{k}")
            for k in tag_keys]
    # latest value of each metric
    aggs += [F.max_by("d", F.when(~F.col("is_tag") & (F.col("key") == k), F.col("ts"))).alias(f"metrics.{k}")
             for k in metric_keys]
    wide = long.groupBy("run_id").agg(*aggs)
    return r.join(wide, "run_id", "left").orderBy(F.desc("start_time"), F.asc("run_id"))


def read_run_records(spark: SparkSession, path: str, schema: str = RUNS_SCHEMA) -> DataFrame:
    """M9 tolerant path: JSON-lines run records; corrupt lines and records
    without a run id are skipped instead of failing the listing."""
    from pyspark.sql import types as T
    base = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType(list(base.fields) + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(with_bad).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.filter(F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull()).drop("_corrupt_record")


@dataclass
class Page:
    rows: DataFrame
    total: int
    has_more: bool


def paginate(df: DataFrame, limit: int = 50, offset: int = 0, order: list | None = None) -> Page:
    """One page after an explicit order; has_more = offset + limit < total."""
    ordered = df.orderBy(*order) if order else df
    total = df.count()
    return Page(ordered.offset(offset).limit(limit), total, offset + limit < total)


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The first run with this id (empty frame if none)."""
    return runs.filter(F.col("run_id") == run_id).orderBy("start_time").limit(1)


def model_details(listed: DataFrame, run_id: str) -> DataFrame:
    """A listed run with defaults for missing model type / dataset."""
    cols = listed.columns
    mt = F.col("`tags.model_type`") if "tags.model_type" in cols else F.lit(None).cast("string")
    ds = F.col("`tags.dataset_name`") if "tags.dataset_name" in cols else F.lit(None).cast("string")
    return (listed.filter(F.col("run_id") == run_id).limit(1)
            .withColumn("model_type", F.coalesce(mt, F.lit(DEFAULT_MODEL_TYPE)))
            .withColumn("dataset_name", F.coalesce(ds, F.lit(DEFAULT_DATASET))))


def run_label(listed: DataFrame) -> Column:
    """M12: 'start | type | dataset | CV:score | ID:first8 [| tag]'."""
    cols = listed.columns

    def c(name, default=None):
        return F.col(f"`{name}`") if name in cols else F.lit(default).cast("string")
    add = F.coalesce(F.when(c("tags.additional_tag") != "N/A", c("tags.additional_tag")),
                     c("tags.output_filename"))
    score = (F.format_string("%.4f", F.col("`metrics.cv_mean_score`")) if "metrics.cv_mean_score" in cols
             else F.lit(None).cast("string"))
    base = F.concat_ws(" | ", F.date_format("start_time", "yyyy-MM-dd HH:mm"),
                       F.coalesce(c("tags.model_type"), F.lit(DEFAULT_MODEL_TYPE)),
                       F.coalesce(c("tags.dataset_name"), F.lit("Unknown Data")),
                       F.concat(F.lit("CV:"), F.coalesce(score, F.lit("N/A"))),
                       F.concat(F.lit("ID:"), F.substring("run_id", 1, 8)))
    return F.when(add.isNotNull() & (add != "N/A"), F.concat(base, F.lit(" | "), add)).otherwise(base)


# ---- M13-M16 ------------------------------------------------------------------------
def job_status(events: DataFrame) -> DataFrame:
    """Latest status per job (ties on ts broken by the event order key),
    first and last event time, event count and latest best score."""
    order = F.struct("ts", *(["event_id"] if "event_id" in events.columns else []))
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("ts").alias("submitted_at"), F.max("ts").alias("last_update"),
        F.count(F.lit(1)).alias("events"),
        F.max_by("best_score", F.when(F.col("best_score").isNotNull(), order)).alias("best_score"))


def job_log(events: DataFrame, job_id: str) -> DataFrame:
    """M13 logs/history: the job's events in time order (a filtered scan)."""
    return events.filter(F.col("job_id") == job_id).orderBy("ts")


def job_summary(status: DataFrame) -> DataFrame:
    """Fixed text for COMPLETED, the error for FAILED, else NULL."""
    err = F.col("error") if "error" in status.columns else F.lit(None).cast("string")
    return status.withColumns({
        "result": F.when(F.col("status") == "COMPLETED", F.lit(JOB_COMPLETED_TEXT)),
        "error": F.when(F.col("status") == "FAILED", err)})


def job_progress(status: Column) -> Column:
    """RUNNING 0.5, COMPLETED 1.0, otherwise 0.0."""
    return (F.when(status == "RUNNING", F.lit(0.5)).when(status == "COMPLETED", F.lit(1.0))
            .otherwise(F.lit(0.0)))


def list_jobs(status_frame: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> Page:
    """Equality filter on status, then M10."""
    f = status_frame if status is None else status_frame.filter(F.col("status") == status)
    return paginate(f, limit, offset, [F.desc("last_update"), F.asc("job_id")])


# ---- M17 ---------------------------------------------------------------------------
def log_run(spark: SparkSession, root: str, run_id: str, start_time, status: str, experiment: str,
            tags: dict, params: dict, metrics: dict) -> None:
    """Append one run with its tags, params (as tags ``param.*``) and metrics."""
    import datetime as dt
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(run_id, start_time, status, experiment)], RUNS_SCHEMA) \
        .write.mode("append").parquet(f"{root}/runs")
    tag_rows = [(run_id, k, str(v)) for k, v in tags.items()] + \
               [(run_id, f"param.{k}", str(v)) for k, v in params.items()]
    if tag_rows:
        spark.createDataFrame(tag_rows, TAGS_SCHEMA).write.mode("append").parquet(f"{root}/run_tags")
    if metrics:
        spark.createDataFrame([(run_id, k, float(v), now) for k, v in metrics.items()], RUN_METRICS_SCHEMA) \
            .write.mode("append").parquet(f"{root}/run_metrics")
