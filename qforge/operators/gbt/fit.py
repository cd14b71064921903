"""T-1/T-7/T-9/T-13: cross-validated quantile boosting on a DataFrame.

``fit_models`` builds the binned training frame once (one shuffle to spread
rows over the cluster, then persisted), and grows every
(target, quantile, fold, parameter set) model in the same passes.  The
final model of each (target, quantile) is grown alongside its CV models and
truncated at the CV best round, so no second training run is needed.
"""

from __future__ import annotations

import random
import threading
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.columns import nan_to_null
from ...session import ensure_checkpoint_dir
from .binning import compute_cuts, n_bins
from .grower import BLOCK_ROWS, Grower, GrowParams, batch_bins, binary_array, make_specs
from .model import ModelSet, QuantileModel


@dataclass
class FitResult:
    model_set: ModelSet
    cv: DataFrame            # (model, target, quantile, trial, round, test_quantile_mean)
    best: list               # rows (model, target, quantile, trial, best_round, best_score)
    jobs: int
    n_rows: int


#: Copies of one row that a single task writes out.
COPIES_PER_TASK = 1 << 16
#: Up to so many copies are written out where the row was counted.
FEW_COPIES = 8
#: Rows of a partition of the training frame, beyond which every core gets one more.
PARTITION_ROWS = 4 * BLOCK_ROWS
#: Rows by which the range of a partition is chosen.
PLACES_PER_PARTITION = 2_000


def with_row_keys(df: DataFrame, key: str = "row_key", copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """The rows of ``df`` with a key of their own that does not depend on how they are dealt out.

    Rows are counted by content (a partial aggregation) and written out again
    as copies 0, 1, ... of their content; the key hashes content and number.
    Equal rows cannot be told apart, so it does not matter which is which.
    Contents with more than a few copies are first cut into ranges of copies
    and dealt out: tasks would else get contents by the size of their counts,
    which says nothing about the rows written.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(copies_per_task).cast("long"))
    least = min(FEW_COPIES, copies_per_task)
    few = counted.filter(F.col("_copies") <= least).withColumn("_first", F.lit(0).cast("long"))
    many = counted.filter(F.col("_copies") > least).withColumn("_first", F.explode(starts))
    # a number of partitions of its own: the ranges are few and small, and would be put together into one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = few.unionByName(many.repartition(tasks, F.xxhash64(*df.columns, "_first")))
    last = F.least(F.col("_copies"), F.col("_first") + copies_per_task) - 1
    rows = ranges.withColumn("_copy", F.explode(F.sequence("_first", last)))
    return rows.select(*df.columns, F.xxhash64(*df.columns, "_copy").alias(key))


def cv_folds(df: DataFrame, nfold: int, key_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """T-7: the rows of ``df`` with ``row_key`` and their ``fold`` in 0..nfold-1, as training deals them."""
    keyed = df.withColumn("row_key", F.xxhash64(*key_cols)) if key_cols else with_row_keys(df)
    return keyed.withColumn("fold", fold_of(F.col("row_key"), nfold, seed))


def fold_of(key: Column, nfold: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(nfold)).cast("int")


def training_frame(df: DataFrame, targets: list[str], features: list[str], weight_col: str | None,
                   key_cols: list[str] | None, nfold: int, seed: int, max_bin: int,
                   partitions: int | None = None, keep_source: bool = False):
    """Project, key, fold and bin the rows; returns (frame, cuts, n, scales).

    Folds and samples follow a key of the row: ``key_cols`` if given (rows of
    one key then stay together), else a key of its own for each row.
    """
    spark = df.sparkSession
    string_feats = [f for f in features if df.schema[f].dataType.typeName() == "string"]
    if string_feats:
        raise ValueError(f"string columns cannot be model features (encode them first): {string_feats}")
    cols = {}
    for t, name in enumerate(targets):
        cols[f"_y{t}"] = nan_to_null(F.col(name).cast("double"))
    cols["_w"] = (F.coalesce(nan_to_null(F.col(weight_col).cast("double")), F.lit(1.0))
                  if weight_col else F.lit(1.0))
    if key_cols:
        cols["_rk"] = F.xxhash64(*[F.col(c) for c in key_cols])
    base = df.select(*features, *[v.alias(k) for k, v in cols.items()])
    base = base.filter(F.greatest(*[F.col(f"_y{t}").isNull().cast("int") for t in range(len(targets))]) == 0) \
        if len(targets) > 1 else base.filter(F.col("_y0").isNotNull())
    if not key_cols:
        # written once: every pass of the trainer would else carry the plan of the counting
        ensure_checkpoint_dir(spark)
        base = with_row_keys(base, "_rk").checkpoint(eager=True)
    k = max(int(nfold or 1), 1)
    base = base.withColumn("_fold", fold_of(F.col("_rk"), k, seed))
    # the cut sketches and the packing both read the projected rows: keep
    # them once instead of recomputing the upstream plan (joins, encoders)
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    stats_aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(F.abs(F.col(f"_y{t}"))).alias(f"s{t}")
                                                     for t in range(len(targets))]
    cuts, stats = compute_cuts(base, features, max_bin, extra_aggs=stats_aggs)
    # values go through the shuffle as they are and are binned where they are packed
    rows = base.select("_rk", "_fold", "_w", *[f"_y{t}" for t in range(len(targets))],
                       *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)])
    rows = _by_cells(rows, [f"_x{j}" for j in range(len(features))], int(stats["n"]), _n_partitions(spark, int(stats["n"]), partitions))
    scales = [max(float(stats[f"s{t}"] or 1.0), 1e-9) * 1e-6 for t in range(len(targets))]
    if keep_source:
        # the caller's first pass packs ``rows`` into blocks; it then drops ``base``
        return rows, cuts, int(stats["n"]), scales, base
    binned = _pack_bins(rows, cuts, len(targets)).persist(StorageLevel.MEMORY_AND_DISK)
    binned.count()
    base.unpersist()
    return binned, cuts, int(stats["n"]), scales


def _by_cells(rows: DataFrame, values: list[str], n: int, parts: int) -> DataFrame:
    """The rows in ``parts`` partitions, those of equal values side by side, so that a block has few cells of many rows.

    The places of rows are ordered by a hash of their values, then one of their key: a partition takes a range of
    places, and values with many rows go to several partitions.  The ranges come from a fixed sample of the rows.
    """
    if parts < 2:
        return rows.coalesce(1)
    low = F.lit((1 << 32) - 1)
    by_key = F.xxhash64("_rk", F.lit(parts))
    place = F.bitwise_not(low).bitwiseAND(F.xxhash64(*values) if values else F.lit(0)).bitwiseOR(by_key.bitwiseAND(low))
    one_in = max(1, n // (PLACES_PER_PARTITION * parts))
    drawn = rows.filter(F.pmod(F.xxhash64("_rk", F.lit("place")), F.lit(one_in)) == 0).select(place.alias("p"))
    found = np.sort(drawn.toArrow()["p"].to_numpy())
    if len(found) < parts:
        return rows.repartition(parts, "_rk")
    bounds = [int(found[i * len(found) // parts]) for i in range(1, parts)]

    def number(a: int, b: int) -> Column:
        """How many of the bounds ``a`` to ``b`` are at or below the place."""
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col("_place") >= F.lit(bounds[mid]).cast("long"), number(mid + 1, b)).otherwise(number(a, mid))

    return rows.withColumn("_place", place).repartitionById(parts, number(0, parts - 1)).drop("_place")


def _n_partitions(spark, n: int, partitions: int | None) -> int:
    """Partitions of the training frame of ``n`` rows.

    Every task of a level pass emits one partial histogram, so the shuffle
    per level is tasks x cells: rows are spread over one partition per core,
    or a few, not one per input split.
    """
    cores = spark.sparkContext.defaultParallelism
    return partitions or cores * max(1, -(-n // (PARTITION_ROWS * cores)))


def _pack_bins(frame: DataFrame, cuts: list[np.ndarray], n_targets: int) -> DataFrame:
    """The rows with one binary value of bins in place of their feature values."""
    keep = ["_rk", "_fold", "_w"] + [f"_y{t}" for t in range(n_targets)]
    schema = ("_rk long, _fold int, _w double, " + "".join(f"_y{t} double, " for t in range(n_targets))
              + "_bins binary")

    def fn(it):
        for batch in it:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(cols + [binary_array(batch_bins(batch, cuts))], names=keep + ["_bins"])

    return frame.mapInArrow(fn, schema)


def fit_models(df: DataFrame, targets: list[str], features: list[str], quantiles: list[float],
               constraints: list[int] | None = None, params: GrowParams | list[GrowParams] | None = None,
               nfold: int = 5, num_boost_round: int = 100, early_stopping_rounds: int | None = 10,
               weight_col: str | None = None, key_cols: list[str] | None = None, max_bin: int = 256,
               seed: int = 42, with_final: bool = True, partitions: int | None = None,
               checkpoint_interval: int = 10, callback=None, prepared: tuple | None = None) -> FitResult:
    """Grow all models on ``df``; ``prepared``, a result of ``training_frame``, stays persisted for further calls."""
    if not targets:
        raise ValueError("at least one target is required")
    _check_labels(quantiles)
    params_list = params if isinstance(params, list) else [params or GrowParams()]
    for p in params_list:
        if p.max_depth < 1:
            raise ValueError("max_depth must be >= 1")
    frame, cuts, n, scales, *source = prepared or training_frame(df, targets, features, weight_col, key_cols, nfold,
                                                                 seed, max_bin, partitions, keep_source=True)
    specs = make_specs(len(targets), quantiles, params_list, nfold, num_boost_round, with_final)
    grower = Grower(frame, len(features), n_bins(cuts), len(targets), constraints or [],
                    specs, scales, seed=seed,
                    early_stopping_rounds=early_stopping_rounds if nfold and nfold > 1 else None,
                    checkpoint_interval=checkpoint_interval, callback=callback, cuts=cuts)
    grower.rows_per_task = -(-n // _n_partitions(df.sparkSession, n, partitions))
    if source:
        grower.on_materialised = source[0].unpersist
    try:
        grower.fit(num_boost_round)
    finally:
        if prepared is None:
            frame.unpersist()
    ms = ModelSet(list(features), cuts, list(constraints or []) + [0] * (len(features) - len(constraints or [])))
    best_rows, cv_rows = [], []
    trials = len(params_list)
    for st, best_round, best_score in grower.results():
        sp = st.spec
        trial = sp.group % trials
        name = f"{targets[sp.target]}_p{int(sp.quantile * 100)}"
        if sp.fold == -1:
            ms.models.append(QuantileModel(name, targets[sp.target], sp.quantile, st.base_score,
                                           st.trees[:best_round], best_round, best_score))
        g = grower.groups.get(sp.group)
        if sp.fold in (-1, 0) and g is not None and (sp.fold == 0 or nfold <= 1):
            best_rows.append((name, targets[sp.target], float(sp.quantile), trial, int(best_round),
                              float(best_score)))
            for r, loss in enumerate(g.curve, start=1):
                cv_rows.append((name, targets[sp.target], float(sp.quantile), trial, r, float(loss)))
    spark = df.sparkSession
    cv = spark.createDataFrame(cv_rows, "model string, target string, quantile double, trial int, "
                                        "round int, test_quantile_mean double")
    return FitResult(ms, cv, best_rows, grower.jobs, n)


def _check_labels(quantiles: list[float]) -> None:
    """Labels p{int(q*100)} must not collide (0.02 and 0.025 both give p2)."""
    seen = {}
    for q in quantiles:
        if not 0.0 <= q <= 1.0:
            raise ValueError(f"quantile {q} outside [0, 1]")
        lbl = int(q * 100)
        if lbl in seen and seen[lbl] != q:
            raise ValueError(f"quantiles {seen[lbl]} and {q} share the label p{lbl}")
        seen[lbl] = q


SEARCH_SPACE = {"eta": (0.01, 0.3), "max_depth": (3, 10), "alpha": (0.0, 10.0),
                "subsample": (0.5, 1.0), "colsample_bytree": (0.5, 1.0)}


def sample_params(n_trials: int, seed: int = 42, base: GrowParams | None = None) -> list[GrowParams]:
    """T-13: seeded random search over the reference's space."""
    rng = random.Random(seed)
    base = base or GrowParams()
    out = []
    for _ in range(n_trials):
        out.append(GrowParams(
            eta=rng.uniform(*SEARCH_SPACE["eta"]),
            max_depth=rng.randint(*SEARCH_SPACE["max_depth"]),
            reg_lambda=base.reg_lambda,
            alpha=rng.uniform(*SEARCH_SPACE["alpha"]),
            min_child_weight=base.min_child_weight,
            gamma=base.gamma,
            subsample=rng.uniform(*SEARCH_SPACE["subsample"]),
            colsample_bytree=rng.uniform(*SEARCH_SPACE["colsample_bytree"])))
    return out


def tune(df: DataFrame, target: str, features: list[str], quantiles: list[float],
         constraints: list[int] | None = None, n_trials: int = 20, nfold: int = 3,
         num_boost_round: int = 100, early_stopping_rounds: int = 10, weight_col: str | None = None,
         seed: int = 42, base: GrowParams | None = None, max_bin: int = 256, key_cols: list[str] | None = None,
         timeout: float | None = None, trials_per_group: int = 4):
    """T-13: first target only; quantile 0.5 if listed else the first.

    All trials x folds grow in the same passes; the score of a trial is the
    minimum of its CV mean curve.  Returns (best params, trials frame, fit
    result with the best trial).

    With a ``timeout`` in seconds, groups of ``trials_per_group`` trials grow
    one after the other on one binned frame.  At the deadline the running
    jobs are cancelled and the finished groups decide; TimeoutError if none is.
    """
    q = 0.5 if 0.5 in quantiles else quantiles[0]
    trials = sample_params(n_trials, seed, base)
    spark = df.sparkSession

    def grow(part: list[GrowParams], prepared: tuple | None = None) -> FitResult:
        return fit_models(df, [target], features, [q], constraints, part, nfold, num_boost_round,
                          early_stopping_rounds, weight_col, key_cols, max_bin, seed, with_final=False,
                          prepared=prepared)

    if timeout is None:
        done = [(0, grow(trials))]
    else:
        done = []
        with _Deadline(spark, timeout) as deadline:
            prepared = training_frame(df, [target], features, weight_col, key_cols, nfold, seed, max_bin)
            try:
                for start in range(0, len(trials), trials_per_group):
                    done.append((start, grow(trials[start:start + trials_per_group], prepared)))
                    if deadline.passed():
                        break
            finally:
                prepared[0].unpersist()
        if not done:
            raise TimeoutError(f"no trial was finished within {timeout} seconds")
    rows = [(start + r[3], r[4], r[5], res) for start, res in done for r in res.best]
    best_trial, _, _, best = min(rows, key=lambda r: (r[2], r[0]))
    table = spark.createDataFrame(
        [(t, trials[t].eta, trials[t].max_depth, trials[t].alpha, trials[t].subsample,
          trials[t].colsample_bytree, best_round, score) for t, best_round, score, _ in rows],
        "trial int, eta double, max_depth int, alpha double, subsample double, "
        "colsample_bytree double, best_round int, score double")
    return trials[best_trial], table, best


class _Deadline:
    """Cancels the Spark jobs of the block from the deadline on and ends the block without an error.

    Errors before the deadline are passed on.
    """

    def __init__(self, spark, seconds: float):
        self.sc, self.seconds, self.tag = spark.sparkContext, seconds, f"qforge-deadline-{uuid.uuid4().hex}"

    def __enter__(self):
        self.end = time.monotonic() + self.seconds
        self.over = threading.Event()
        self.sc.addJobTag(self.tag)
        self.watch = threading.Thread(target=self._cancel, daemon=True)
        self.watch.start()
        return self

    def passed(self) -> bool:
        return time.monotonic() >= self.end

    def _cancel(self) -> None:
        # again and again: a job may start between a cancellation and the error it raises
        wait = self.seconds
        while not self.over.wait(max(wait, 0.0)):
            self.sc.cancelJobsWithTag(self.tag)
            wait = 0.2

    def __exit__(self, kind, error, trace) -> bool:
        self.over.set()
        self.watch.join()
        self.sc.removeJobTag(self.tag)
        return kind is not None and issubclass(kind, Exception) and self.passed() and "cancel" in str(error).lower()


__all__ = ["fit_models", "tune", "cv_folds", "with_row_keys", "FitResult", "sample_params", "training_frame"]
