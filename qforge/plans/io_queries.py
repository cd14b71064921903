"""Registered source/sink queries: write a given table, read it back.

Outputs go to a fresh folder under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp dir.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import runs as M
from ..session import ensure_checkpoint_dir
from ..sources import io as S
from .registry import load, query


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/qforge-io/{name}-{uuid.uuid4().hex[:12]}"


@query("csv_roundtrip", oracle="SELECT * FROM orders")
def csv_roundtrip(spark, sf):
    """S8 write then S1 read (explicit schema: no inference pass)."""
    o = load(spark, sf, "orders")
    path = _scratch(spark, "orders_csv")
    S.write_csv(o, path)
    return S.read_table(spark, path, schema=o.schema, fmt="csv")


@query("validate_csv", oracle="""
SELECT true AS ok, CAST(NULL AS VARCHAR) AS error, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders
""")
def validate_csv(spark, sf):
    """S2 on a CSV written from the orders table."""
    o = load(spark, sf, "orders")
    path = _scratch(spark, "orders_csv")
    S.write_csv(o, path)
    v = S.validate_table(spark, path, schema=o.schema)
    return v.df.agg(F.lit(v.ok).alias("ok"), F.lit(v.error).cast("string").alias("error"),
                    F.count(F.lit(1)).alias("n_rows"), F.lit(len(v.df.columns)).cast("long").alias("n_columns"))


@query("validate_csv_texts", oracle="""
SELECT true AS ok, CAST(NULL AS VARCHAR) AS error, count(*) AS n_rows, count(*) AS same_text,
       count(*) FILTER (WHERE contains(text, chr(10))) AS over_lines
FROM documents
""")
def validate_csv_texts(spark, sf):
    """S2 on a CSV of all documents: quoted texts over many lines come back whole."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = _scratch(spark, "documents_csv")
    S.write_csv(d, path)
    v = S.validate_table(spark, path, schema=d.schema)
    both = v.df.select("doc_id", F.coalesce("text", F.lit("")).alias("again")).join(d, "doc_id")
    return both.agg(F.lit(v.ok).alias("ok"), F.lit(v.error).cast("string").alias("error"), F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col("again") == F.col("text")).alias("same_text"),
                    F.count_if(F.contains("text", F.lit("\n"))).alias("over_lines"))


@query("json_roundtrip", oracle="SELECT * FROM customer")
def json_roundtrip(spark, sf):
    """S7 write (records, ISO dates) then S3 read."""
    c = load(spark, sf, "customer")
    path = _scratch(spark, "customer_json")
    S.write_json_records(c, path)
    return S.read_json_records(spark, path, schema=c.schema, lines=True)


@query("json_columns", oracle="""
SELECT n_regionkey AS _doc, CAST(n_nationkey AS VARCHAR) AS _idx, n_name,
       CAST(n_nationkey * 10 AS VARCHAR) AS code
FROM nation
""")
def json_columns(spark, sf):
    """Column-oriented JSON documents ({col: {idx: value}}) back to rows."""
    n = load(spark, sf, "nation")
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.create_map(
        F.lit("n_name"), F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))),
        F.lit("code"), F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"),
                                                                  (F.col("n_nationkey") * 10).cast("string"))))
    )).alias("doc"))
    return S.read_json_columns(docs, "doc", key_col="n_regionkey").withColumnRenamed("_doc", "_doc")


@query("sample_head", oracle="SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_head(spark, sf):
    """The first 50 rows under an explicit order."""
    return S.sample_head(load(spark, sf, "orders"), 50, ["o_orderkey"])


@query("describe_schema")
def describe_schema(spark, sf):
    """Columns, types and row count of every driver table."""
    rows = []
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        cols, types, n = S.describe_schema(load(spark, sf, t))
        rows += [(t, c, types[c], n) for c in cols]
    return spark.createDataFrame(rows, "table string, column string, dtype string, n_rows long")


@query("export_metrics", oracle="SELECT event_type AS metric_name, value FROM events")
def export_metrics(spark, sf):
    """S9 (observations CSV) and S10 (JSON summary) of a timing table."""
    metrics = load(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    path = _scratch(spark, "metrics")
    S.export_metrics_csv(metrics, f"{path}/csv")
    S.export_metrics_json(M.performance_summary_doc(metrics), f"{path}/json", spark)
    return S.read_table(spark, f"{path}/csv", schema="metric_name string, value double", fmt="csv")


@query("model_roundtrip", oracle="""
SELECT c_mktsegment, count(*) AS row_count, count(*) AS same_prediction, CAST(1 AS BIGINT) AS models
FROM customer GROUP BY c_mktsegment
""")
def model_roundtrip(spark, sf):
    """A forecaster of customers' balances by city and segment, saved and loaded by run id.

    Every customer lives in a city of its own (as many as customers); it is
    fitted on those with even keys and must predict all of them the same
    after loading.
    """
    from ..config import FeatureSpec, ForecastConfig
    from ..operators.forecast import QuantileForecaster
    key = F.col("c_custkey")
    rows = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("city "), key.cast("string")).alias("city"),
                                              "c_acctbal")
    cities = rows.select(F.col("city").alias("name"), (F.lit(30.0) + key % 97 * 0.2).alias("lat"),
                         (F.lit(-120.0) + key % 101 * 0.5).alias("lon"))
    segments = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
    cfg = ForecastConfig(
        targets=["c_acctbal"], quantiles=[0.5], features=[FeatureSpec("city_Enc", 0), FeatureSpec("c_mktsegment_Enc", 0)],
        mappings={"levels": {}, "segments": segments, "location_targets": {"city 2": 1, "city 4": 2, "city 6": 3}},
        ranked_cols={"c_mktsegment": "segments"}, proximity_cols=["city"], max_distance_km=400.0,
        training={"max_depth": 3}, cv={"num_boost_round": 3, "nfold": 2})
    fitted = QuantileForecaster(cfg, cities).train(rows.filter(key % 2 == 0), key_cols=["c_custkey"])
    path = _scratch(spark, "models")
    fitted.save(path, "demo-run")
    loaded = QuantileForecaster.load(spark, path, "demo-run")
    before, after = (f.predict(rows, "long", keep=["c_custkey", "c_mktsegment"]) for f in (fitted, loaded))
    both = before.join(after.select("c_custkey", F.col("prediction").alias("again")), "c_custkey")
    return both.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("prediction") == F.col("again")).alias("same_prediction"),
        F.countDistinct("quantile").alias("models"))


@query("log_runs")
def log_runs(spark, sf):
    """M17 + M8: log the demo training run, then list it from the tables."""
    from .model_queries import trained
    fc = trained(spark, sf)
    root = _scratch(spark, "runs")
    M.log_run(spark, root, "demo-run", dt.datetime(2024, 1, 1), "FINISHED", "demo",
              tags={"dataset_name": "lineitem", "model_type": "XGBoost"},
              params={"remove_outliers": False, "tune": False, "rows": -1},
              metrics={"cv_mean_score": fc.cv_mean_score(), **fc.timings})
    runs = spark.read.parquet(f"{root}/runs")
    tags = spark.read.parquet(f"{root}/run_tags")
    mets = spark.read.parquet(f"{root}/run_metrics")
    return M.list_models(runs, tags, mets)
