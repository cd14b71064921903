"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureSpec, ForecastConfig
from ..operators import analysis as V
from ..operators.forecast import QuantileForecaster
from . import (feature_queries, io_queries, model_queries, ops_queries, profile_queries,  # noqa: F401
               published_queries, stream_queries)
from .registry import ORACLES, QUERIES, load, query


def flagship_config() -> ForecastConfig:
    """SURVEY §7.1 slice: p50 of l_extendedprice, depth 3, 10 rounds."""
    return ForecastConfig(
        targets=["l_extendedprice"], quantiles=[0.5],
        features=[FeatureSpec("l_quantity", 1), FeatureSpec("l_discount", 0), FeatureSpec("l_tax", 0)],
        date_col="l_shipdate", ref_date="2002-01-01 00:00:00",
        training={"max_depth": 3, "eta": 0.3},
        cv={"num_boost_round": 10, "nfold": 3, "early_stopping_rounds": 5})


@query("flagship_forecast")
def flagship(spark, sf_dir):
    """read -> IQR outlier filter -> recency weights -> CV-trained p50 model
    -> long predictions over the whole table -> pinball loss per model."""
    li = load(spark, sf_dir, "lineitem")
    fc = QuantileForecaster(flagship_config())
    fc.train(li, remove_outliers=True, key_cols=model_queries.KEY)
    pred = fc.predict(li, "long", keep=model_queries.KEY + ["l_extendedprice"])
    return V.pinball_loss(pred, "l_extendedprice").withColumn(
        "removed_outliers", F.lit(int(fc.removed)).cast("long"))


__all__ = ["QUERIES", "ORACLES", "flagship"]
