"""Scoring and validation.

Validation is a projection: every row gets an ``errors array<string>``
built from Column expressions (``filter(array(when ...), isNotNull)``), so
one bad row never fails the batch; frame-level misses (absent columns) are
computed once from the schema.  Rows are scored by the model set's
scorer (a compiled expression or an Arrow UDF) in the same projection;
invalid rows keep their errors, status 400 and no predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import model_label


@dataclass
class ModelSchema:
    """What a model needs as input."""
    ranked: dict            # raw column -> mapping {level: code}
    proximity: list         # raw location columns
    numerical: list         # other raw numeric inputs
    all_features: list
    targets: list
    quantiles: list

    @classmethod
    def from_config(cls, cfg) -> "ModelSchema":
        ranked = {c: (k if isinstance(k, dict) else cfg.mapping(k)) for c, k in cfg.ranked_cols.items()}
        prox = list(cfg.proximity_cols)
        derived = {f"{c}_Enc" for c in list(ranked) + prox}
        for col, enc in cfg.optional_encodings.items():
            kind = enc.get("type") if isinstance(enc, dict) else enc
            suffix = {"cost_of_living": "_CostOfLiving", "metro_population": "_MetroPopulation",
                      "normalize_recent": "_Normalized", "least_recent": "_Normalized"}.get(kind)
            if suffix:
                derived.add(f"{col}{suffix}")
        # Derived optional-encoding features are not raw inputs; their raw column is
        raw_optional = [c for c in cfg.optional_encodings if c not in ranked and c not in prox]
        numerical = [f for f in cfg.feature_names() if f not in derived and f not in ranked and f not in prox]
        numerical += [c for c in raw_optional if c not in numerical]
        return cls(ranked, prox, numerical, cfg.feature_names(), list(cfg.targets), list(cfg.quantiles))

    def to_frame(self, spark) -> DataFrame:
        rows = ([(c, "ranked", list(m)) for c, m in self.ranked.items()]
                + [(c, "proximity", None) for c in self.proximity]
                + [(c, "numerical", None) for c in self.numerical])
        return spark.createDataFrame(rows, "feature string, kind string, levels array<string>")


def _levels_text(levels: list[str]) -> str:
    shown = ", ".join(levels[:10])
    return shown + ("..." if len(levels) > 10 else "")


def validation_errors(df: DataFrame, schema: ModelSchema) -> tuple[list[str], Column]:
    """(frame-level errors, per-row error array column)."""
    cols = set(df.columns)
    frame_errors = []
    for label, names in (("ranked", list(schema.ranked)), ("proximity", schema.proximity),
                         ("numerical", schema.numerical)):
        missing = sorted(set(names) - cols)
        if missing:
            frame_errors.append(f"Missing {label} features: {', '.join(missing)}")
    checks = []
    for col, mapping in schema.ranked.items():
        if col not in cols:
            continue
        levels = [str(k) for k in mapping]
        v = F.col(col).cast("string")
        checks.append(F.when(v.isNull() | ~v.isin(*levels), F.concat(
            F.lit(f"Invalid value for ranked feature '{col}': '"), F.coalesce(v, F.lit("None")),
            F.lit(f"'. Valid values: {_levels_text(levels)}"))))
    for col in schema.numerical:
        if col not in cols:
            continue
        v = F.col(col)
        bad = v.isNotNull() & v.cast("string").try_cast("double").isNull()
        checks.append(F.when(bad, F.concat(
            F.lit(f"Invalid value for numerical feature '{col}': '"), v.cast("string"),
            F.lit("'. Expected numeric value."))))
    row_errors = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    if frame_errors:
        row_errors = F.concat(F.array(*[F.lit(e) for e in frame_errors]), row_errors)
    return frame_errors, row_errors


def validate_features(df: DataFrame, schema: ModelSchema) -> DataFrame:
    """P2 as columns: ``errors`` and ``is_valid`` appended to every row."""
    _, errs = validation_errors(df, schema)
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def predict_batch(df: DataFrame, schema: ModelSchema, scorer_wide, index_col: str,
                  zone: Column | None = None) -> DataFrame:
    """Validate every row, score every row, keep predictions of valid ones.

    ``scorer_wide(frame) -> frame + one {target}_p{NN} column per model``.
    Scoring never fails on a bad value (unknown levels encode to -1,
    non-numbers to missing), so the whole batch is one narrow projection:
    no join and no shuffle.  Output: index, status_code (200 valid / 400
    invalid), error, predictions map target -> (p## -> value), and the
    location zone when given (J8).  No row is dropped.
    """
    checked = validate_features(df, schema)
    scored = scorer_wide(checked)
    by_target: dict[str, list[str]] = {}
    for t in schema.targets:
        for q in schema.quantiles:
            by_target.setdefault(t, []).append(f"{t}_p{int(q * 100)}")
    pred_map = F.create_map(*[x for t, cols in by_target.items() for x in (
        F.lit(t), F.create_map(*[y for c in cols for y in (F.lit(c.rsplit("_", 1)[1]), F.col(c))]))])
    out = scored.select(
        index_col,
        F.when(F.col("is_valid"), F.lit(200)).otherwise(F.lit(400)).alias("status_code"),
        F.when(~F.col("is_valid"), F.concat(F.lit("Invalid input features: "),
                                            F.array_join("errors", "; "))).alias("error"),
        F.when(F.col("is_valid"), pred_map).alias("predictions"),
        *([zone.alias("location_zone")] if zone is not None else []))
    return out


def batch_summary(results: DataFrame) -> DataFrame:
    """P5: total, success_count, failure_count."""
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.col("status_code") == 200).alias("success_count"),
                       F.count_if(F.col("status_code") != 200).alias("failure_count"))


def format_predictions_wide(wide: DataFrame, index_col: str, targets: list[str],
                            quantiles: list[float]) -> DataFrame:
    """P6 from the wide layout: one row per (row, target) with a column per
    p## -- an ``explode`` of per-target structs, no shuffle."""
    labels = [f"p{int(q * 100)}" for q in quantiles]
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("Component"), *[F.col(f"{t}_{lbl}").alias(lbl) for lbl in labels])
        for t in targets]))
    return wide.select(index_col, rows.alias("_r")).select(index_col, "_r.*")


def quantile_curve_wide(wide: DataFrame, index_col: str, targets: list[str],
                        quantiles: list[float]) -> DataFrame:
    """P7 from the wide layout: one row per (row, p##) with a column per
    target, in numeric quantile order -- narrow, no shuffle."""
    order = sorted(quantiles, key=lambda q: int(q * 100))
    rows = F.explode(F.array(*[
        F.struct(F.lit(f"p{int(q * 100)}").alias("Quantile"),
                 *[F.col(f"{t}_p{int(q * 100)}").alias(t) for t in targets])
        for q in order]))
    return wide.select(index_col, rows.alias("_r")).select(index_col, "_r.*")


def format_predictions(long: DataFrame, index_col: str, quantiles: list[float]) -> DataFrame:
    """One row per (row, target) named ``Component``, one column per p##."""
    labels = [f"p{int(q * 100)}" for q in quantiles]
    return (long.withColumn("label", model_label(F.col("quantile")))
            .groupBy(index_col, F.col("target").alias("Component"))
            .pivot("label", labels).agg(F.first("prediction")))


def quantile_curve(long: DataFrame, index_col: str, targets: list[str]) -> DataFrame:
    """One row per p## and one column per target, ordered by the number after p."""
    return (long.withColumn("Quantile", model_label(F.col("quantile")))
            .groupBy(index_col, "Quantile").pivot("target", targets).agg(F.first("prediction"))
            .withColumn("_o", F.substring("Quantile", 2, 10).cast("int"))
            .orderBy(index_col, "_o").drop("_o"))


def available_targets(meta: DataFrame) -> list[str]:
    """Sorted targets of a model_meta table."""
    return sorted(r["target"] for r in meta.select("target").distinct().collect())


def available_quantiles(meta: DataFrame, target: str) -> list[float]:
    return sorted(r["quantile"] for r in meta.filter(F.col("target") == target)
                  .select("quantile").distinct().collect())


def parse_model_name(name: Column) -> tuple[Column, Column]:
    """P9 fallback: ``{target}_p{NN}`` -> (target, NN/100)."""
    target = F.regexp_extract(name, r"^(.*)_p(\d+)$", 1)
    q = F.regexp_extract(name, r"^(.*)_p(\d+)$", 2).try_cast("int") / F.lit(100.0)
    return target, q
