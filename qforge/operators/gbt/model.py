"""Model set: trees for every (target, quantile), persisted as tables.

Tables (Parquet, partitioned by ``run_id`` so a load prunes partitions)::

    trees(run_id, model, tree, node, feature, split_bin, split_value,
          default_left, left, right, leaf, gain, cover)
    bins(run_id, feature, name, cuts)
    model_meta(run_id, model, target, quantile, base_score, best_round,
               best_score, constraint_list, features)

Scoring (P1): very small model sets are compiled into one Catalyst expression
(nested ``CASE WHEN`` per tree, summed), so scoring stays in the JVM and
in whole-stage codegen; others ship the tree arrays to executors in a
size-checked broadcast and walk them with NumPy inside a scalar Arrow UDF
that receives only the feature columns.  The expression becomes part of one
generated method, and the JVM interprets methods of more than 8,000 bytes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .trees import Tree, route_values

MAX_BROADCAST_BYTES = 512 << 20
# up to this many split nodes a model set scores as one Catalyst expression: the JVM does not compile longer methods
EXPR_MAX_NODES = 20


@dataclass
class QuantileModel:
    name: str
    target: str
    quantile: float
    base_score: float
    trees: list
    best_round: int
    best_score: float


@dataclass
class ModelSet:
    features: list[str]
    cuts: list[np.ndarray]
    constraints: list[int]
    models: list[QuantileModel] = field(default_factory=list)

    # -- metadata (P8, P9) --------------------------------------------------
    def targets(self) -> list[str]:
        return sorted({m.target for m in self.models})

    def quantiles(self, target: str) -> list[float]:
        return sorted({m.quantile for m in self.models if m.target == target})

    def model(self, target: str, quantile: float) -> QuantileModel | None:
        for m in self.models:
            if m.target == target and abs(m.quantile - quantile) < 1e-12:
                return m
        return None

    # -- arrays shipped to executors ---------------------------------------
    def _compiled(self):
        out = []
        for m in self.models:
            trees = []
            for t in m.trees:
                arr = t.arrays()
                sv = np.full(t.n_nodes, np.nan)
                for i in range(t.n_nodes):
                    if arr["left"][i] >= 0:
                        sv[i] = self.cuts[arr["feature"][i]][arr["split_bin"][i] - 1]
                trees.append((arr, sv, max(t.depth)))
            out.append((m.target, m.quantile, m.base_score, trees))
        return out

    def nbytes(self) -> int:
        return sum(t.n_nodes * 64 for m in self.models for t in m.trees) + 1024

    # -- scoring (P1) -------------------------------------------------------
    def n_split_nodes(self) -> int:
        return sum(sum(1 for x in t.left if x >= 0) for m in self.models for t in m.trees)

    def predict(self, df: DataFrame, layout: str = "long", keep: list[str] | None = None,
                engine: str = "auto") -> DataFrame:
        """Score every (target, quantile) model on every row.

        ``layout="wide"`` appends ``{target}_p{int(q*100)}`` columns;
        ``"long"`` returns ``keep + (target, quantile, prediction)``.
        ``engine="expr"`` compiles the trees into one Catalyst expression
        (JVM only, whole-stage codegen); ``"arrow"`` walks them in NumPy in
        a scalar Arrow UDF; ``"auto"`` uses the expression up to
        ``EXPR_MAX_NODES`` split nodes.
        """
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing feature columns: {missing}")
        if engine == "expr" or (engine == "auto" and self.n_split_nodes() <= EXPR_MAX_NODES):
            return self._predict_expr(df, layout, keep)
        return self._predict_arrow(df, layout, keep)

    def _tree_expr(self, t: Tree, x: list):
        def node(i):
            if t.left[i] < 0:
                return F.lit(float(t.value[i]))
            f = t.feature[i]
            split = float(self.cuts[f][t.split_bin[i] - 1])
            xv = x[f]
            go_left = F.when(xv.isNull() | F.isnan(xv), F.lit(bool(t.default_left[i]))).otherwise(xv < F.lit(split))
            return F.when(go_left, node(t.left[i])).otherwise(node(t.right[i]))
        return node(0)

    def _predict_expr(self, df: DataFrame, layout: str, keep: list[str] | None) -> DataFrame:
        keep = list(df.columns) if keep is None else list(keep)
        x = [F.col(f).try_cast("double") for f in self.features]
        preds = []
        for m in self.models:
            total = F.lit(float(m.base_score))
            for t in m.trees:
                total = total + self._tree_expr(t, x)
            preds.append(total)
        labels = [_label(m) for m in self.models]
        if layout == "wide":
            return df.select(*keep, *[p.alias(lbl) for p, lbl in zip(preds, labels)])
        cells = F.explode(F.array(*[
            F.struct(F.lit(m.target).alias("target"), F.lit(m.quantile).alias("quantile"), p.alias("prediction"))
            for m, p in zip(self.models, preds)]))
        return df.select(*keep, cells.alias("_c")).select(*keep, "_c.*")

    def _predict_arrow(self, df: DataFrame, layout: str, keep: list[str] | None) -> DataFrame:
        spark = df.sparkSession
        size = self.nbytes()
        if size > MAX_BROADCAST_BYTES:
            raise ValueError(f"model set of ~{size} bytes exceeds the broadcast bound")
        bc = spark.sparkContext.broadcast(self._compiled())
        feats = list(self.features)
        names = [f"p{i}" for i in range(len(self.models))]
        out_type = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

        # Only the feature columns travel to Python (a scalar Arrow UDF);
        # every other column stays in the JVM row.
        @F.pandas_udf(out_type)
        def score(*cols: pd.Series) -> pd.DataFrame:
            compiled = bc.value
            n = len(cols[0]) if cols else 0
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in cols], axis=1) \
                if cols else np.zeros((n, 0))
            out = {}
            for i, (_t, _q, base, trees) in enumerate(compiled):
                p = np.full(n, base, np.float64)
                for arr, sv, depth in trees:
                    node = route_values(arr, x, sv, depth) if depth > 0 else np.zeros(n, np.int64)
                    p += arr["value"][node]
                out[names[i]] = p
            return pd.DataFrame(out, columns=names)

        keep = list(df.columns) if keep is None else list(keep)
        # a value that is not a number scores as missing (validation reports it)
        args = [F.col(f).try_cast("double") for f in feats] or [F.lit(0.0)]
        scored = df.select(*keep, score(*args).alias("__s"))
        labels = [_label(m) for m in self.models]
        if layout == "wide":
            return scored.select(*keep, *[F.col(f"__s.{n}").alias(lbl) for n, lbl in zip(names, labels)])
        cells = F.explode(F.array(*[
            F.struct(F.lit(m.target).alias("target"), F.lit(m.quantile).alias("quantile"),
                     F.col(f"__s.{n}").alias("prediction"))
            for m, n in zip(self.models, names)]))
        return scored.select(*keep, cells.alias("_c")).select(*keep, "_c.*")

    # -- tables (S11, S12) ------------------------------------------------
    def tables(self, spark: SparkSession, run_id: str):
        tree_rows, meta_rows = [], []
        for m in self.models:
            for ti, t in enumerate(m.trees):
                for i in range(t.n_nodes):
                    leaf = t.left[i] < 0
                    f = None if leaf else int(t.feature[i])
                    sb = None if leaf else int(t.split_bin[i])
                    sv = None if leaf else float(self.cuts[f][sb - 1])
                    tree_rows.append((run_id, m.name, ti, i, f, sb, sv, bool(t.default_left[i]),
                                      None if leaf else int(t.left[i]), None if leaf else int(t.right[i]),
                                      float(t.value[i]) if leaf else None, float(t.gain[i]),
                                      float(t.cover[i])))
            meta_rows.append((run_id, m.name, m.target, float(m.quantile), float(m.base_score),
                              int(m.best_round), float(m.best_score)))
        trees = spark.createDataFrame(tree_rows, TREES_SCHEMA)
        bins = spark.createDataFrame(
            [(run_id, j, name, [float(x) for x in self.cuts[j]], int(self.constraints[j]))
             for j, name in enumerate(self.features)], BINS_SCHEMA)
        meta = spark.createDataFrame(meta_rows, META_SCHEMA)
        return trees, bins, meta

    def save(self, spark: SparkSession, path: str, run_id: str, config: dict | None = None) -> None:
        trees, bins, meta = self.tables(spark, run_id)
        for name, frame in (("trees", trees), ("bins", bins), ("model_meta", meta)):
            (frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run_id").parquet(f"{path}/{name}"))
        if config is not None:
            spark.createDataFrame([(run_id, json.dumps(config, sort_keys=True))],
                                  "run_id string, config string") \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy("run_id").parquet(f"{path}/configs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, run_id: str) -> "ModelSet":
        try:
            meta = spark.read.parquet(f"{path}/model_meta").filter(F.col("run_id") == run_id).collect()
        except Exception as exc:  # path missing
            raise ModelNotFoundError(run_id) from exc
        if not meta:
            raise ModelNotFoundError(run_id)
        bins = spark.read.parquet(f"{path}/bins").filter(F.col("run_id") == run_id).orderBy("feature").collect()
        rows = (spark.read.parquet(f"{path}/trees").filter(F.col("run_id") == run_id)
                .orderBy("model", "tree", "node").collect())
        by_model: dict[str, dict[int, list]] = {}
        for r in rows:
            by_model.setdefault(r["model"], {}).setdefault(r["tree"], []).append(r)
        ms = cls([b["name"] for b in bins], [np.asarray(b["cuts"], np.float64) for b in bins],
                 [int(b["constraint"]) for b in bins])
        for m in meta:
            trees = []
            for ti in sorted(by_model.get(m["model"], {})):
                nodes = by_model[m["model"]][ti]
                t = Tree(feature=[], split_bin=[], default_left=[], left=[], right=[], value=[],
                         gain=[], cover=[], depth=[], lower=[], upper=[])
                for r in nodes:
                    leaf = r["left"] is None
                    t.feature.append(-1 if leaf else r["feature"])
                    t.split_bin.append(-1 if leaf else r["split_bin"])
                    t.default_left.append(bool(r["default_left"]))
                    t.left.append(-1 if leaf else r["left"])
                    t.right.append(-1 if leaf else r["right"])
                    t.value.append(r["leaf"] if leaf else 0.0)
                    t.gain.append(r["gain"])
                    t.cover.append(r["cover"])
                    t.depth.append(0)
                    t.lower.append(-np.inf)
                    t.upper.append(np.inf)
                _fill_depth(t)
                trees.append(t)
            ms.models.append(QuantileModel(m["model"], m["target"], m["quantile"], m["base_score"],
                                           trees, m["best_round"], m["best_score"]))
        return ms


class ModelNotFoundError(LookupError):
    def __init__(self, run_id: str):
        super().__init__(f"Model not found for run_id: {run_id}")
        self.run_id = run_id


def _fill_depth(t: Tree) -> None:
    stack = [(0, 0)]
    while stack:
        i, d = stack.pop()
        t.depth[i] = d
        if t.left[i] >= 0:
            stack += [(t.left[i], d + 1), (t.right[i], d + 1)]


def _label(m: QuantileModel) -> str:
    return f"{m.target}_p{int(m.quantile * 100)}"


TREES_SCHEMA = ("run_id string, model string, tree int, node int, feature int, split_bin int, "
                "split_value double, default_left boolean, left int, right int, leaf double, "
                "gain double, cover double")
BINS_SCHEMA = "run_id string, feature int, name string, cuts array<double>, constraint int"
META_SCHEMA = ("run_id string, model string, target string, quantile double, base_score double, "
               "best_round int, best_score double")

__all__ = ["ModelSet", "QuantileModel", "ModelNotFoundError"]
