"""Registered training, scoring and model-analysis queries.

The model is trained once per (session, data folder) and memoised on the
driver (only tree metadata is kept); every query below scores or inspects
the whole joined ``lineitem x orders`` table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureSpec, ForecastConfig
from ..functions.columns import pinball
from ..operators import analysis as V
from ..operators import score as S
from ..operators.forecast import QuantileForecaster, best_round
from ..operators.gbt.fit import cv_folds
from ..operators.stats import exact_quantiles
from .registry import load, query

# The demonstration model on the TPC-H-like tables.
PRIORITY_LEVELS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
QUANTILES = [0.1, 0.5, 0.9]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Row keys that one task tells apart.
KEYS_PER_TASK = 1 << 19


def demo_config(rounds: int = 10, depth: int = 3, nfold: int = 3) -> ForecastConfig:
    return ForecastConfig(
        targets=["l_extendedprice"],
        features=[FeatureSpec("l_quantity", 1), FeatureSpec("l_discount", 0), FeatureSpec("l_tax", 0),
                  FeatureSpec("o_orderpriority_Enc", 0)],
        quantiles=list(QUANTILES), date_col="l_shipdate", ref_date="2002-01-01 00:00:00",
        mappings={"levels": {}, "location_targets": {}, "priority": dict(PRIORITY_LEVELS)},
        ranked_cols={"o_orderpriority": "priority"},
        training={"max_depth": depth, "eta": 0.3}, cv={"num_boost_round": rounds, "nfold": nfold,
                                                        "early_stopping_rounds": 5})


def joined(spark, sf):
    li = load(spark, sf, "lineitem")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey")


_MEMO: dict = {}


def trained(spark, sf) -> QuantileForecaster:
    key = (id(spark), sf)
    if key not in _MEMO:
        fc = QuantileForecaster(demo_config())
        fc.train(joined(spark, sf), remove_outliers=False, key_cols=KEY)
        _MEMO[key] = fc
    return _MEMO[key]


@query("cv_folds", oracle="""
SELECT l_quantity, l_discount, l_tax, count(*) AS row_count, count(*) AS distinct_keys, true AS folds_even
FROM lineitem GROUP BY ALL
""")
def cv_folds_q(spark, sf):
    """T-7: copies of one row have keys of their own and are dealt evenly over the folds.

    Even: no fold has more than a third of the copies and six standard deviations.
    """
    content = ["l_quantity", "l_discount", "l_tax"]
    table = load(spark, sf, "lineitem").select(*content)
    # one partition for so many keys, whatever the session's number: a task's memory does not grow with the table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // KEYS_PER_TASK))
    rows = cv_folds(table, 3).repartition(tasks, *content, "fold", "row_key")
    per_fold = rows.groupBy(*content, "fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_key").alias("keys"))
    out = per_fold.groupBy(*content).agg(F.sum("n").alias("row_count"), F.sum("keys").alias("distinct_keys"), F.max("n").alias("most"))
    even = F.col("most") <= F.col("row_count") / 3 + 6 * F.sqrt(F.col("row_count") * 2 / 9)
    return out.withColumn("folds_even", even).drop("most")


@query("pinball_constant", oracle="""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
                  quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem)
SELECT CAST(0.1 AS DOUBLE) AS quantile, round(p10, 6) AS prediction,
       round(avg(greatest(0.1 * (l_extendedprice - p10), (0.1 - 1.0) * (l_extendedprice - p10))), 6) AS pinball_loss
FROM lineitem, q GROUP BY p10
UNION ALL
SELECT CAST(0.5 AS DOUBLE), round(p50, 6), round(avg(greatest(0.5 * (l_extendedprice - p50), (0.5 - 1.0) * (l_extendedprice - p50))), 6)
FROM lineitem, q GROUP BY p50
UNION ALL
SELECT CAST(0.9 AS DOUBLE), round(p90, 6), round(avg(greatest(0.9 * (l_extendedprice - p90), (0.9 - 1.0) * (l_extendedprice - p90))), 6)
FROM lineitem, q GROUP BY p90
""")
def pinball_constant(spark, sf):
    """T-3/V3 baseline: the constant q-quantile model and its mean pinball loss."""
    li = load(spark, sf, "lineitem")
    qs = exact_quantiles(li, ["l_extendedprice"], QUANTILES)["l_extendedprice"]
    aggs = [F.avg(pinball("l_extendedprice", F.lit(p), q)).alias(f"l{i}") for i, (q, p) in enumerate(zip(QUANTILES, qs))]
    row = li.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(q).alias("quantile"), F.round(F.lit(p), 6).alias("prediction"),
                 F.round(F.col(f"l{i}"), 6).alias("pinball_loss"))
        for i, (q, p) in enumerate(zip(QUANTILES, qs))])).alias("s")).select("s.*")


@query("train_models")
def train_models(spark, sf):
    """T-1/T-2/T-4/T-5/T-6/T-9: CV-tuned rounds, final models per quantile."""
    fc = trained(spark, sf)
    rows = [(m.name, m.target, float(m.quantile), float(m.base_score), int(m.best_round),
             float(m.best_score), len(m.trees), sum(t.n_nodes for t in m.trees))
            for m in fc.model_set.models]
    return spark.createDataFrame(rows, "model string, target string, quantile double, base_score double, "
                                       "best_round int, best_score double, n_trees int, n_nodes int")


@query("cv_curve")
def cv_curve(spark, sf):
    """T-7: mean held-out pinball loss per model and boosting round."""
    return trained(spark, sf).cv


@query("cv_best_round")
def cv_best_round(spark, sf):
    """T-8: first arg-min round of every CV curve."""
    return best_round(trained(spark, sf).cv)


@query("train_report")
def train_report(spark, sf):
    """T-14 / T-15: (Model, Best Round, Score) and the run's mean CV score."""
    fc = trained(spark, sf)
    return fc.train_report().withColumn("cv_mean_score", F.lit(fc.cv_mean_score()))


@query("predict_long")
def predict_long(spark, sf):
    """Every row x every (target, quantile)."""
    fc = trained(spark, sf)
    return fc.predict(joined(spark, sf), "long", keep=KEY + ["l_extendedprice"])


@query("predict_wide")
def predict_wide(spark, sf):
    fc = trained(spark, sf)
    return fc.predict(joined(spark, sf), "wide", keep=KEY)


@query("pinball_by_model")
def pinball_by_model(spark, sf):
    """V3: mean pinball loss of each final model on all rows."""
    return V.pinball_loss(predict_long(spark, sf), "l_extendedprice")


@query("feature_importance")
def feature_importance(spark, sf):
    """V1: average split gain per feature, from the persisted trees table."""
    fc = trained(spark, sf)
    trees, bins, _ = fc.model_set.tables(spark, "demo")
    return V.feature_importance(trees, bins)


@query("top_features")
def top_features(spark, sf):
    """V2: the top-20 features of each model."""
    return V.top_features(feature_importance(spark, sf), 20)


@query("monotonicity_check")
def monotonicity_check(spark, sf):
    """V4: predictions never drop as l_quantity (+1 constraint) grows."""
    long = trained(spark, sf).predict(joined(spark, sf), "long",
                                      keep=["l_quantity", "l_discount", "l_tax", "o_orderpriority"])
    return V.monotonicity_violations(long, "l_quantity",
                                     ["target", "quantile", "l_discount", "l_tax", "o_orderpriority"])


@query("quantile_crossings")
def quantile_crossings(spark, sf):
    """V4: rows where p10 > p50 or p50 > p90 (the model does not prevent it)."""
    wide = predict_wide(spark, sf)
    return V.quantile_crossings(wide, [f"l_extendedprice_p{int(q * 100)}" for q in QUANTILES])


@query("format_predictions")
def format_predictions(spark, sf):
    """One row per (row, target) with a column per quantile."""
    fc = trained(spark, sf)
    rows = joined(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))
    wide = fc.predict(rows, "wide", keep=["row_id"])
    return S.format_predictions_wide(wide, "row_id", ["l_extendedprice"], QUANTILES)


@query("quantile_curve")
def quantile_curve(spark, sf):
    """One row per p## with a column per target."""
    fc = trained(spark, sf)
    rows = joined(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))
    wide = fc.predict(rows, "wide", keep=["row_id"])
    return S.quantile_curve_wide(wide, "row_id", ["l_extendedprice"], QUANTILES)


@query("model_schema")
def model_schema(spark, sf):
    """Required raw inputs of the demo model."""
    return S.ModelSchema.from_config(demo_config()).to_frame(spark)


# -- validation (SQL-checkable: it needs the schema only) ----------------------
_BAD_PRIORITY = "CASE WHEN l_linenumber = 7 THEN 'BOGUS' ELSE o_orderpriority END"
_BAD_QTY = "CASE WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END"
_VALID_LEVELS = ", ".join(PRIORITY_LEVELS)


def _dirty(spark, sf):
    j = joined(spark, sf)
    pr = F.when(F.col("l_linenumber") == 7, F.lit("BOGUS")).otherwise(F.col("o_orderpriority"))
    qty = F.when(F.col("l_orderkey") % 13 == 0, F.lit("n/a")).otherwise(
        F.col("l_quantity").cast("long").cast("string"))
    return j.withColumn("o_orderpriority", pr).withColumn("l_quantity", qty)


_VALIDATE_SQL = f"""
WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, {_BAD_PRIORITY} AS pr, {_BAD_QTY} AS qty
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS (SELECT *,
         CASE WHEN pr IS NULL OR pr NOT IN ({", ".join(f"'{k}'" for k in PRIORITY_LEVELS)})
              THEN 'Invalid value for ranked feature ''o_orderpriority'': ''' || coalesce(pr, 'None')
                   || '''. Valid values: {_VALID_LEVELS}' END AS e1,
         CASE WHEN qty IS NOT NULL AND TRY_CAST(qty AS DOUBLE) IS NULL
              THEN 'Invalid value for numerical feature ''l_quantity'': ''' || qty
                   || '''. Expected numeric value.' END AS e2
       FROM j)
"""


@query("validate_features", oracle=_VALIDATE_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (e1 IS NULL AND e2 IS NULL) AS is_valid,
       CAST((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT AS INTEGER) AS n_errors,
       concat_ws('; ', e1, e2) AS error_text
FROM e
""")
def validate_features(spark, sf):
    """Per-row errors for bad levels and non-numeric numbers."""
    schema = S.ModelSchema.from_config(demo_config())
    out = S.validate_features(_dirty(spark, sf), schema)
    return out.select(*KEY, "is_valid", F.size("errors").alias("n_errors"),
                      F.array_join("errors", "; ").alias("error_text"))


@query("batch_summary", oracle=_VALIDATE_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE e1 IS NULL AND e2 IS NULL) AS success_count,
       count(*) FILTER (WHERE NOT (e1 IS NULL AND e2 IS NULL)) AS failure_count
FROM e
""")
def batch_summary(spark, sf):
    """Score a dirty batch row by row; invalid rows get status 400."""
    fc = trained(spark, sf)
    schema = S.ModelSchema.from_config(fc.cfg)
    dirty = _dirty(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))

    results = S.predict_batch(dirty, schema, lambda d: fc.predict(d, "wide"), "row_id")
    return S.batch_summary(results)


@query("predict_batch")
def predict_batch(spark, sf):
    """(index, status_code, error, predictions) for every row of the batch."""
    fc = trained(spark, sf)
    schema = S.ModelSchema.from_config(fc.cfg)
    dirty = _dirty(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))
    return S.predict_batch(dirty, schema, lambda d: fc.predict(d, "wide"), "row_id")


@query("tune_trials")
def tune_trials(spark, sf):
    """T-13: seeded random search, all trials x folds in shared passes."""
    fc = QuantileForecaster(demo_config(rounds=8))
    _, table = fc.tune(joined(spark, sf), n_trials=4, nfold=3, num_boost_round=8, early_stopping_rounds=4)
    return table


__all__ = ["trained", "demo_config", "joined"]


@query("available_models")
def available_models(spark, sf):
    """Targets and quantiles from the model_meta table, and the same
    parsed back from the model names."""
    fc = trained(spark, sf)
    _, _, meta = fc.model_set.tables(spark, "demo")
    target, q = S.parse_model_name(F.col("model"))
    return meta.select("model", "target", "quantile", target.alias("name_target"), q.alias("name_quantile"))


@query("predict_batch_zone")
def predict_batch_zone(spark, sf):
    """J8 + P3: batch results carrying the location zone of every row (the
    ordering customer's nation, zoned against the nation gazetteer)."""
    from ..operators import encode as E
    from .feature_queries import ZONE_MAX_KM, ZONE_TARGETS, _gazetteer
    fc = trained(spark, sf)
    schema = S.ModelSchema.from_config(fc.cfg)
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("location"))
    loc = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.col("o_orderkey").alias("l_orderkey"), "location"))
    rows = _dirty(spark, sf).join(loc, "l_orderkey", "left").withColumn("row_id", F.concat_ws("-", *KEY))
    zoned = E.LocationZoneEncoder.create("location", ZONE_TARGETS, ZONE_MAX_KM, "zone", "_zone",
                                         "haversine").setGazetteer(_gazetteer(spark, sf)).fit(rows).transform(rows)
    return S.predict_batch(zoned, schema, lambda d: fc.predict(d, "wide"), "row_id",
                           zone=F.col("location_zone"))
