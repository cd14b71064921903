"""Model analysis (V1-V4) over the ``trees`` table and prediction frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pinball


def feature_importance(trees: DataFrame, bins: DataFrame, model: str | None = None) -> DataFrame:
    """V1: average gain per split feature (used features only), descending.

    ``importance_type="gain"`` is the mean gain over the splits on a feature.
    """
    t = trees.filter(F.col("feature").isNotNull())
    if model is not None:
        t = t.filter(F.col("model") == model)
    names = bins.select(F.col("run_id").alias("_run"), F.col("feature").alias("_fid"),
                        F.col("name").alias("_fname"))
    g = (t.groupBy("run_id", "model", "feature").agg(F.avg("gain").alias("Gain"),
                                                     F.count(F.lit(1)).alias("splits")))
    # bins has one row per model feature: a small, bounded side
    j = g.join(F.broadcast(names), (F.col("feature") == F.col("_fid")) & (F.col("run_id") == F.col("_run")))
    out = j.select("run_id", "model", F.col("_fname"), "Gain", "splits").withColumnRenamed("_fname", "Feature")
    return out.orderBy("model", F.desc("Gain"), "Feature")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    """V2: the k most important features of every model (a top-k report)."""
    w = Window.partitionBy("run_id", "model").orderBy(F.desc("Gain"), "Feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pinball_loss(pred: DataFrame, label_col: str, pred_col: str = "prediction",
                 quantile_col: str = "quantile", weight_col: str | None = None,
                 by: list[str] | None = None) -> DataFrame:
    """V3 / T-3: weighted mean pinball loss per (target, quantile)."""
    by = by or ["target", quantile_col]
    w = F.col(weight_col) if weight_col else F.lit(1.0)
    loss = pinball(F.col(label_col), F.col(pred_col), F.col(quantile_col), w)
    return pred.groupBy(*by).agg((F.sum(loss) / F.sum(w)).alias("pinball_loss"),
                                 F.count(F.lit(1)).alias("n"))


def monotonicity_violations(pred: DataFrame, feature: str, group_cols: list[str],
                            pred_col: str = "prediction", tol: float = 1e-9) -> DataFrame:
    """V4: predictions must not decrease as ``feature`` grows with the other
    inputs (``group_cols``) fixed.

    Rows are first reduced to (inputs, feature value) -> min/max prediction
    (a partial+final aggregate, so a hot input combination collapses before
    the shuffle); ``lag`` then walks the distinct feature values of each
    input combination and counts drops.
    """
    per_value = pred.groupBy(*group_cols, feature).agg(F.min(pred_col).alias("_mn"),
                                                       F.max(pred_col).alias("_mx"))
    w = Window.partitionBy(*group_cols).orderBy(feature)
    keys = [c for c in group_cols if c in ("target", "quantile")]
    return (per_value.withColumn("_drop", (F.lag("_mx").over(w) - F.col("_mn")) > F.lit(tol))
            .groupBy(*keys).agg(F.count_if("_drop").alias("violations"),
                                F.count(F.lit(1)).alias("checked")))


def quantile_crossings(wide: DataFrame, labels: list[str]) -> DataFrame:
    """V4: rows where a lower quantile's prediction exceeds a higher one's."""
    conds = [F.col(a) > F.col(b) for a, b in zip(labels, labels[1:])]
    crossed = conds[0]
    for c in conds[1:]:
        crossed = crossed | c
    return wide.agg(F.count_if(crossed).alias("crossings"), F.count(F.lit(1)).alias("rows"))
