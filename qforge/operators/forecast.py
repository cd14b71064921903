"""End-to-end forecaster (T-1, T-13, P1, S11/S12).

``QuantileForecaster(cfg).train(df)`` runs, all as Spark jobs:
clean (C4) -> optional outlier filter (C6) -> encoder pipeline fit/transform
(E12) -> recency weights (E7) -> CV + final fit of every (target, quantile)
in shared passes (T-1/T-7/T-9).  ``predict`` applies the same cleaning of
experience columns (T19), the fitted encoders and the tree scorer.
"""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForecastConfig
from . import clean as C
from .encode import SampleWeighterModel, build_pipeline, weight_stage
from .gbt.fit import fit_models, tune
from .gbt.grower import GrowParams
from .gbt.model import ModelSet

WEIGHT_COL = "__weight"


class QuantileForecaster:
    def __init__(self, cfg: ForecastConfig | dict, gazetteer: DataFrame | None = None,
                 geo_method: str = "geodesic"):
        self.cfg = cfg if isinstance(cfg, ForecastConfig) else ForecastConfig.from_dict(cfg)
        self.gazetteer = gazetteer
        self.geo_method = geo_method
        self.encoders: PipelineModel | None = None
        self.weighter = None
        self.model_set: ModelSet | None = None
        self.cv: DataFrame | None = None
        self.best: list = []
        self.timings: dict[str, float] = {}
        self.removed = 0

    # -- steps -------------------------------------------------------------
    def prepare(self, df: DataFrame, remove_outliers: bool = False) -> DataFrame:
        """Clean, then optionally filter outliers (counts one job)."""
        t0 = time.perf_counter()
        cleaned, removed = C.prepare_training(df, self.cfg.targets, remove_outliers,
                                              date_col=self.cfg.date_col)
        self.removed = removed or 0
        self.timings["preprocessing_cleaning_time"] = time.perf_counter() - t0
        return cleaned

    def fit_encoders(self, df: DataFrame) -> DataFrame:
        t0 = time.perf_counter()
        self.encoders = build_pipeline(self.cfg, self.gazetteer, self.geo_method).fit(df)
        self.weighter = weight_stage(self.cfg).fit(df)
        out = self.transform(df, with_weight=True)
        self.timings["preprocessing_feature_encoding_time"] = time.perf_counter() - t0
        return out

    def transform(self, df: DataFrame, with_weight: bool = False) -> DataFrame:
        if self.encoders is None:
            raise ValueError("encoders are not fitted")
        out = self.encoders.transform(C.clean(df, [], date_col=self.cfg.date_col))
        if with_weight:
            out = self.weighter.transform(out).withColumnRenamed(self.weighter._out(), WEIGHT_COL)
        missing = [f for f in self.cfg.feature_names() if f not in out.columns]
        if missing:
            raise ValueError(f"Features not found after encoding: {missing}")
        return out

    # -- training ------------------------------------------------------------
    def train(self, df: DataFrame, remove_outliers: bool = False, callback=None,
              params: GrowParams | None = None, key_cols: list[str] | None = None,
              max_bin: int = 256, checkpoint_interval: int = 10) -> "QuantileForecaster":
        cleaned = self.prepare(df, remove_outliers)
        encoded = self.fit_encoders(cleaned)
        cvp = self.cfg.cv
        params = params or GrowParams.from_dict(self.cfg.training)
        t0 = time.perf_counter()
        res = fit_models(encoded, self.cfg.targets, self.cfg.feature_names(), self.cfg.quantiles,
                         self.cfg.constraints(), params, int(cvp.get("nfold", 5)),
                         int(cvp.get("num_boost_round", 100)),
                         cvp.get("early_stopping_rounds", 10), WEIGHT_COL, key_cols, max_bin,
                         seed=42, callback=callback, checkpoint_interval=checkpoint_interval)
        self.timings["training_time"] = time.perf_counter() - t0
        self.model_set, self.cv, self.best = res.model_set, res.cv, res.best
        self.jobs = res.jobs
        return self

    def tune(self, df: DataFrame, n_trials: int = 20, nfold: int = 3, num_boost_round: int = 100,
             early_stopping_rounds: int = 10, max_bin: int = 256, key_cols: list[str] | None = None,
             timeout: float | None = None):
        """T-13 on the cleaned frame (T18); best params go into the config; ``timeout`` in seconds."""
        cleaned = self.prepare(df, False)
        encoded = self.fit_encoders(cleaned)
        best, table, _ = tune(encoded, self.cfg.targets[0], self.cfg.feature_names(), self.cfg.quantiles,
                              self.cfg.constraints(), n_trials, nfold, num_boost_round,
                              early_stopping_rounds, WEIGHT_COL, 42,
                              GrowParams.from_dict(self.cfg.training), max_bin, key_cols, timeout)
        self.cfg.training.update({"eta": best.eta, "max_depth": best.max_depth, "alpha": best.alpha,
                                  "subsample": best.subsample, "colsample_bytree": best.colsample_bytree})
        return best, table

    # -- scoring -----------------------------------------------------------------
    def predict(self, df: DataFrame, layout: str = "long", keep: list[str] | None = None) -> DataFrame:
        if self.model_set is None:
            raise ValueError("model is not trained")
        encoded = self.transform(df)
        keep = list(df.columns) if keep is None else keep
        return self.model_set.predict(encoded, layout, keep=keep)

    def cv_mean_score(self) -> float:
        """T-15: mean of all models' best scores (mixes targets, like the reference)."""
        scores = [r[5] for r in self.best]
        return float(sum(scores) / len(scores)) if scores else float("nan")

    def train_report(self) -> DataFrame:
        """T-14: (Model, Best Round, Score) per trained model."""
        spark = self.cv.sparkSession
        return spark.createDataFrame([(r[0], int(r[4]), float(r[5])) for r in self.best],
                                     "Model string, `Best Round` int, Score double")

    # -- persistence ---------------------------------------------------------
    def save(self, path: str, run_id: str) -> None:
        """Everything ``load`` needs under ``path``, by ``run_id``: model tables and configuration, encoders
        (with the tables of zones and levels), weighter and the CV curve.  A run that is saved again is replaced."""
        spark = self.cv.sparkSession
        self.encoders.write().overwrite().save(f"{path}/encoders/{run_id}")
        self.weighter.write().overwrite().save(f"{path}/weighter/{run_id}")
        best = spark.createDataFrame([(run_id, *r) for r in self.best], f"run_id string, {BEST_SCHEMA}")
        for name, frame in (("cv", self.cv.withColumn("run_id", F.lit(run_id))), ("best", best)):
            (frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run_id").parquet(f"{path}/{name}"))
        self.model_set.save(spark, path, run_id, {**self.cfg.to_dict(), "geo_method": self.geo_method})

    @classmethod
    def load(cls, spark: SparkSession, path: str, run_id: str) -> "QuantileForecaster":
        """The forecaster saved as ``run_id``, ready to predict.  Raises ``ModelNotFoundError``."""
        models = ModelSet.load(spark, path, run_id)  # also says whether the run exists
        of_run = F.col("run_id") == run_id
        config = json.loads(spark.read.parquet(f"{path}/configs").filter(of_run).first()["config"])
        out = cls(config, geo_method=config.pop("geo_method", "geodesic"))
        out.model_set = models
        out.encoders = PipelineModel.load(f"{path}/encoders/{run_id}")
        out.weighter = SampleWeighterModel.load(f"{path}/weighter/{run_id}")
        out.cv = spark.read.parquet(f"{path}/cv").filter(of_run).drop("run_id")
        out.best = [tuple(r) for r in spark.read.parquet(f"{path}/best").filter(of_run).drop("run_id").orderBy("model", "trial").collect()]
        return out


BEST_SCHEMA = "model string, target string, quantile double, trial int, best_round int, best_score double"


def best_round(cv: DataFrame, metric: str = "test_quantile_mean") -> DataFrame:
    """T-8: first arg-min round (1-based) and its score per model.

    ``min_by(struct(loss, round))`` picks the smallest loss, the earliest
    round on ties; a partial+final aggregate, no window over all rows.
    """
    if metric not in cv.columns:
        raise ValueError(f"metric {metric} not found in CV results")
    best = F.min(F.struct(F.col(metric).alias("score"), F.col("round").alias("round")))
    return cv.groupBy("model").agg(best.alias("b")).select(
        "model", F.col("b.round").alias("best_round"), F.col("b.score").alias("best_score"))


__all__ = ["QuantileForecaster", "best_round"]
