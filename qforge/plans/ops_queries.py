"""Registered run, job, usage and text queries over the driver tables.

* ``events`` doubles as a timing table (metric = event_type) and as a job
  event log (job = user, status from the event type);
* ``conversations`` gives per-conversation LLM usage (tokens estimated from
  text length);
* ``orders`` doubles as a run table (status from o_orderstatus);
* ``documents`` / ``conversations`` texts feed the text jobs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as H
from ..functions.columns import estimate_tokens, format_cost
from ..operators import runs as M
from .registry import load, query

# ---- timing table ----------------------------------------------------------------


def _metrics(spark, sf):
    return load(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("value"))


@query("metric_stats", oracle="""
SELECT event_type AS metric, count(*) AS count, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
       min(value) AS min, max(value) AS max
FROM events GROUP BY event_type
""")
def metric_stats(spark, sf):
    out = M.metric_stats(_metrics(spark, sf))
    return out.withColumn("total", F.round("total", 6)).withColumn("mean", F.round("mean", 6))


@query("performance_summary", oracle=f"""
WITH s AS (SELECT event_type AS metric, count(*) AS count, sum(value) AS total FROM events GROUP BY 1)
SELECT metric, count, round(total, 6) AS total,
       metric IN ({", ".join(f"'{m}'" for m in M.PREPROCESSING_METRICS)}) AS is_preprocessing,
       CAST(0.0 AS DOUBLE) AS preprocessing_total
FROM s
""")
def performance_summary(spark, sf):
    out = M.performance_summary(_metrics(spark, sf))
    return out.select("metric", "count", F.round("total", 6).alias("total"), "is_preprocessing",
                      "preprocessing_total")


# ---- usage table from conversations -----------------------------------------------
_PROVIDER_SQL = "CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'Gemini' ELSE 'local' END"
_MODEL_SQL = ("CASE conv_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'GPT-4o-mini' WHEN 2 THEN 'gemini-1.5-pro' "
              "WHEN 3 THEN 'gemini-ultra' ELSE 'unknown-model' END")


def _calls(spark, sf):
    c = load(spark, sf, "conversations")
    tok = estimate_tokens(F.col("text"))
    per = c.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", tok).otherwise(F.lit(0))).cast("long").alias("prompt_tokens"),
        F.sum(F.when(F.col("role") == "assistant", tok).otherwise(F.lit(0))).cast("long").alias("completion_tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(F.lit(0))).alias("_chars"))
    k3, k5 = F.col("conv_id") % 3, F.col("conv_id") % 5
    provider = F.when(k3 == 0, "openai").when(k3 == 1, "Gemini").otherwise("local")
    model = (F.when(k5 == 0, "gpt-4o").when(k5 == 1, "GPT-4o-mini").when(k5 == 2, "gemini-1.5-pro")
             .when(k5 == 3, "gemini-ultra").otherwise("unknown-model"))
    return per.select("conv_id", model.alias("model"), provider.alias("provider"), "prompt_tokens",
                      "completion_tokens", F.lit(None).cast("long").alias("total_tokens"),
                      (F.col("_chars") / F.lit(1000.0)).alias("latency"))


_CALLS_SQL = f"""
calls AS (
  SELECT conv_id, {_MODEL_SQL} AS model, {_PROVIDER_SQL} AS provider,
         CAST(sum(CASE WHEN role <> 'assistant' THEN floor(length(text) / 4) ELSE 0 END) AS BIGINT) AS prompt_tokens,
         CAST(sum(CASE WHEN role = 'assistant' THEN floor(length(text) / 4) ELSE 0 END) AS BIGINT) AS completion_tokens,
         sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) / 1000.0 AS latency
  FROM conversations GROUP BY conv_id),
prices(pkey, pp, cp) AS (VALUES {", ".join(f"('{p}|{m}', {v[0]}, {v[1]})" for p, ms in M.PRICES.items() for m, v in ms.items())}),
costed AS (
  SELECT c.*, prompt_tokens + completion_tokens AS total_tokens,
         CASE WHEN lower(provider) IN ('openai', 'gemini') THEN
           prompt_tokens / 1000000.0 * coalesce(p.pp, d.pp) + completion_tokens / 1000000.0 * coalesce(p.cp, d.cp)
         ELSE 0.0 END AS cost
  FROM calls c
  LEFT JOIN prices p ON p.pkey = lower(provider) || '|' || lower(model)
  LEFT JOIN prices d ON d.pkey = CASE lower(provider) WHEN 'openai' THEN 'openai|gpt-3.5-turbo'
                                                     WHEN 'gemini' THEN 'gemini|gemini-pro' END)
"""


@query("call_cost", oracle=f"""
WITH {_CALLS_SQL}
SELECT conv_id, model, provider, prompt_tokens, completion_tokens, total_tokens,
       round(cost, 12) AS cost FROM costed
""")
def call_cost(spark, sf):
    out = M.call_cost(_calls(spark, sf))
    return out.select("conv_id", "model", "provider", "prompt_tokens", "completion_tokens", "total_tokens",
                      F.round("cost", 12).alias("cost"))


@query("usage_summary", oracle=f"""
WITH {_CALLS_SQL}
SELECT model, provider, count(*) AS call_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       round(sum(cost), 9) AS total_cost,
       round(coalesce(avg(latency) FILTER (WHERE latency > 0), 0.0), 9) AS avg_latency
FROM costed GROUP BY model, provider
""")
def usage_summary(spark, sf):
    out = M.usage_summary(M.call_cost(_calls(spark, sf)))
    return (out.withColumn("total_cost", F.round("total_cost", 9))
            .withColumn("avg_latency", F.round("avg_latency", 9)))


@query("format_cost", oracle=f"""
WITH {_CALLS_SQL}
SELECT conv_id, CASE WHEN cost < 0.01 THEN '$' || printf('%.2f', cost * 1000) || ' (millicents)'
                     WHEN cost < 1.0 THEN '$' || printf('%.4f', cost)
                     ELSE '$' || printf('%.2f', cost) END AS cost_label
FROM costed
""")
def format_cost_q(spark, sf):
    out = M.call_cost(_calls(spark, sf))
    return out.select("conv_id", format_cost("cost").alias("cost_label"))


@query("estimate_tokens", oracle="""
SELECT conv_id, turn, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM conversations
""")
def estimate_tokens_q(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


# ---- runs from orders -----------------------------------------------------------------
_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END"


def _runs(spark, sf):
    o = load(spark, sf, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "RUNNING")
              .otherwise("FAILED"))
    run_id = F.concat(F.lit("run-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    runs = o.select(run_id.alias("run_id"), F.col("o_orderdate").alias("start_time"),
                    status.alias("status"), F.col("o_orderpriority").alias("experiment"))
    tags = o.select(run_id.alias("run_id"), F.explode(F.array(
        F.struct(F.lit("dataset_name").alias("key"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("value")),
        F.struct(F.lit("model_type").alias("key"), F.lit("XGBoost").alias("value")))).alias("t")).select("run_id", "t.*")
    mets = o.select(run_id.alias("run_id"), F.lit("cv_mean_score").alias("key"),
                    (F.col("o_totalprice") / F.lit(1e6)).alias("value"),
                    F.col("o_orderdate").alias("ts"))
    return runs, tags, mets


_RUNS_SQL = f"""
r AS (SELECT 'run-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS run_id, o_orderdate AS start_time,
             {_STATUS_SQL} AS status, o_orderpriority AS experiment,
             'customer_' || CAST(o_custkey AS VARCHAR) AS ds, o_totalprice / 1e6 AS score
      FROM orders)
"""


@query("list_models", oracle=f"""
WITH {_RUNS_SQL}
SELECT run_id, start_time, status, experiment, ds AS "tags.dataset_name", 'XGBoost' AS "tags.model_type",
       score AS "metrics.cv_mean_score"
FROM r WHERE status = 'FINISHED'
ORDER BY start_time DESC, run_id LIMIT 50 OFFSET 100
""")
def list_models(spark, sf):
    """M8 + M10: the third page of 50 finished runs, newest first."""
    runs, tags, mets = _runs(spark, sf)
    listed = M.list_models(runs, tags, mets, tag_keys=["dataset_name", "model_type"], metric_keys=["cv_mean_score"])
    page = M.paginate(listed, 50, 100, [F.desc("start_time"), F.asc("run_id")])
    return page.rows


@query("run_labels", oracle=f"""
WITH {_RUNS_SQL}
SELECT run_id, strftime(start_time, '%Y-%m-%d %H:%M') || ' | XGBoost | ' || ds || ' | CV:' || printf('%.4f', score)
       || ' | ID:' || substr(run_id, 1, 8) AS label
FROM r WHERE status = 'FINISHED'
""")
def run_labels(spark, sf):
    """M12 over every finished run."""
    runs, tags, mets = _runs(spark, sf)
    listed = M.list_models(runs, tags, mets, tag_keys=["dataset_name", "model_type"], metric_keys=["cv_mean_score"])
    return listed.select("run_id", M.run_label(listed).alias("label"))


@query("model_details", oracle=f"""
WITH {_RUNS_SQL}
SELECT run_id, start_time, status, experiment, ds AS "tags.dataset_name", 'XGBoost' AS "tags.model_type",
       score AS "metrics.cv_mean_score", 'XGBoost' AS model_type, ds AS dataset_name
FROM r WHERE status = 'FINISHED' AND run_id = (SELECT min(run_id) FROM r WHERE status = 'FINISHED')
""")
def model_details(spark, sf):
    """Details of one run (the first finished run id)."""
    runs, tags, mets = _runs(spark, sf)
    listed = M.list_models(runs, tags, mets, tag_keys=["dataset_name", "model_type"], metric_keys=["cv_mean_score"])
    first = runs.filter(F.col("status") == "FINISHED").agg(F.min("run_id")).collect()[0][0]
    return M.model_details(listed, first)


# ---- job events from events ------------------------------------------------------------
_JOB_STATUS_SQL = ("CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' "
                   "WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END")


def _job_events(spark, sf):
    e = load(spark, sf, "events")
    et = F.col("event_type")
    status = (F.when(et == "signup", "QUEUED").when(et == "view", "RUNNING").when(et == "purchase", "COMPLETED")
              .when(et == "error", "FAILED").otherwise("RUNNING"))
    return e.select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), "ts", "event_id",
                    status.alias("status"), F.col("value").alias("best_score"))


_JOBS_SQL = f"""
ev AS (SELECT 'job-' || CAST(user_id AS VARCHAR) AS job_id, ts, event_id, {_JOB_STATUS_SQL} AS status,
              value AS best_score FROM events),
latest AS (SELECT job_id, status, best_score FROM (
             SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
           WHERE rn = 1),
agg AS (SELECT job_id, min(ts) AS submitted_at, max(ts) AS last_update, count(*) AS events FROM ev GROUP BY job_id),
js AS (SELECT agg.job_id, latest.status, submitted_at, last_update, events, latest.best_score
       FROM agg JOIN latest ON agg.job_id = latest.job_id)
"""


@query("job_status", oracle=f"""
WITH {_JOBS_SQL}
SELECT job_id, status, submitted_at, last_update, events, best_score,
       CAST(CASE status WHEN 'RUNNING' THEN 0.5 WHEN 'COMPLETED' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS progress,
       CASE WHEN status = 'COMPLETED' THEN '{M.JOB_COMPLETED_TEXT}' END AS result
FROM js
""")
def job_status(spark, sf):
    """M13 + M14 + M15 for every job."""
    st = M.job_status(_job_events(spark, sf))
    out = M.job_summary(st).withColumn("progress", M.job_progress(F.col("status")))
    return out.select("job_id", "status", "submitted_at", "last_update", "events", "best_score", "progress",
                      "result")


@query("list_jobs", oracle=f"""
WITH {_JOBS_SQL}
SELECT job_id, status, submitted_at, last_update, events, best_score FROM js WHERE status = 'COMPLETED'
ORDER BY last_update DESC, job_id LIMIT 20
""")
def list_jobs(spark, sf):
    """First page of completed jobs."""
    st = M.job_status(_job_events(spark, sf))
    return M.list_jobs(st, "COMPLETED", 20, 0).rows


# ---- text jobs -------------------------------------------------------------------------
_PROPS_SQL = ("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Result: ' || props || ' (done)' "
              "WHEN 2 THEN '''' || props || '''' ELSE 'no json here' END")


@query("repair_json", oracle=f"""
WITH t AS (SELECT event_id, {_PROPS_SQL} AS raw FROM events),
 s AS (SELECT event_id, raw,
         CASE WHEN json_valid(raw) THEN 1
              WHEN (starts_with(trim(raw), '''') AND ends_with(trim(raw), '''') AND length(trim(raw)) >= 2
                    AND json_valid(substr(trim(raw), 2, length(trim(raw)) - 2))) THEN 2
              WHEN contains(raw, '{{') AND contains(raw, '}}')
                   AND json_valid(substr(raw, strpos(raw, '{{'), length(raw) - strpos(reverse(raw), '}}') + 1 - strpos(raw, '{{') + 1)) THEN 6
         END AS strategy FROM t)
SELECT event_id, strategy,
       TRY_CAST(json_extract_string(CASE strategy WHEN 1 THEN raw
                 WHEN 2 THEN substr(trim(raw), 2, length(trim(raw)) - 2)
                 WHEN 6 THEN substr(raw, strpos(raw, '{{'), length(raw) - strpos(reverse(raw), '}}') + 1 - strpos(raw, '{{') + 1)
               END, '$.k') AS BIGINT) AS k
FROM s
""")
def repair_json(spark, sf):
    """H1 over every event payload, with three damaged variants."""
    e = load(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Result: "), "props", F.lit(" (done)")))
           .when(k == 2, F.concat(F.lit("'"), "props", F.lit("'"))).otherwise(F.lit("no json here")))
    r = H.repair_json_frame(e.select("event_id", raw.alias("raw")), "raw", "r", with_unicode_step=False)
    return r.select("event_id", F.col("r.strategy").alias("strategy"),
                    F.try_variant_get("r.value", "$.k", "bigint").alias("k"))


@query("extract_fenced_json", oracle="""
WITH t AS (SELECT conv_id, turn,
             CASE turn % 3 WHEN 0 THEN 'Answer:' || chr(10) || '```json' || chr(10) || '{"turn": ' || CAST(turn AS VARCHAR) || '}' || chr(10) || '```'
                           WHEN 1 THEN 'See {"turn": ' || CAST(turn AS VARCHAR) || '} above'
                           ELSE role END AS txt FROM conversations),
 b AS (SELECT conv_id, turn, CASE WHEN contains(txt, '```json') THEN trim(split_part(split_part(txt, '```json', 2), '```', 1))
                                  WHEN contains(txt, '```') THEN trim(split_part(txt, '```', 2))
                                  ELSE trim(txt) END AS body FROM t)
SELECT conv_id, turn,
       CASE WHEN starts_with(body, '{') AND ends_with(body, '}') THEN body
            WHEN contains(body, '{') AND contains(body, '}') AND strpos(body, '{') < length(body) - strpos(reverse(body), '}') + 1
              THEN substr(body, strpos(body, '{'), length(body) - strpos(reverse(body), '}') + 1 - strpos(body, '{') + 1)
            ELSE body END AS extracted
FROM b
""")
def extract_fenced_json(spark, sf):
    """H2 over every conversation turn, wrapped three ways."""
    c = load(spark, sf, "conversations")
    k = F.col("turn") % 3
    t = F.col("turn").cast("string")
    txt = (F.when(k == 0, F.concat(F.lit("Answer:\n```json\n{\"turn\": "), t, F.lit("}\n```")))
           .when(k == 1, F.concat(F.lit("See {\"turn\": "), t, F.lit("} above"))).otherwise(F.col("role")))
    return c.select("conv_id", "turn", H.extract_fenced_json(txt).alias("extracted"))


def _inj_sql(table: str, key: str) -> str:
    parts = []
    for name, pat in H.INJECTION_FAMILIES.items():
        p = pat.replace("'", "''")
        parts.append(f"SELECT {key}, 'text' AS \"column\", '{name}' AS family, "
                     f"substr(regexp_extract(text, '{p}', 0), 1, 100) AS excerpt "
                     f"FROM {table} WHERE regexp_matches(text, '{p}')")
    return "\nUNION ALL\n".join(parts)


@query("flag_injection", oracle=_inj_sql("documents", "doc_id"))
def flag_injection(spark, sf):
    """H4: instruction-like pattern hits in every document."""
    return H.flag_injection(load(spark, sf, "documents"), "doc_id", ["text"])


@query("flag_injection_conversations", oracle=_inj_sql("conversations", "conv_id"))
def flag_injection_conversations(spark, sf):
    return H.flag_injection(load(spark, sf, "conversations"), "conv_id", ["text"])


@query("redact_text", oracle="""
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '... [truncated]' ELSE text END AS redacted,
       '[DataFrame JSON, length=' || CAST(length(text) AS VARCHAR) || ']' AS payload
FROM documents
""")
def redact_text(spark, sf):
    """H5 over every document."""
    d = load(spark, sf, "documents")
    return d.select("doc_id", H.redact_log_args(F.col("text"), 500).alias("redacted"),
                    H.redact_log_args(F.col("text"), payload=True).alias("payload"))
