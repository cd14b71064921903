"""Distributed, level-wise growth of many quantile boosting models at once.

Rows come as one frame::

    _rk long (row key: a real key or a content hash), _fold int, _w double,
    _y0.._yT double (labels), _bins binary (one byte per feature bin, 0 = missing),
    or the feature values _x0.. double, to be binned by the cuts as they are packed

and are packed once into *blocks* of up to ``BLOCK_ROWS`` rows, one record
each.  In a block the rows of one bin vector (a *cell*) stand side by side,
those of one fold together (a *segment*), sorted by label.  Trees see bins
only, so routing and predictions are done once a cell; and as all rows of a
segment have one prediction, sums over those above or below a residual take a
binary search a segment and prefix sums.  Where no two rows share a cell this
costs what routing every row would.  A block is one record of flat arrays: nothing is copied value by value
between the JVM and Python, and tasks hold one block at a time.

A *model* is (target, quantile, fold or full data, parameter set).  All
active models share every pass over the rows:

* level pass (one per tree level): routes each cell through the model's
  partial tree and builds dense per-task histograms of the pinball gradient
  with ``np.bincount``; ``groupBy(cell).sum`` reduces them across tasks; the
  driver receives models x nodes x features x bins cells and picks the splits.
  The level-0 pass also returns the weighted pinball loss of the current
  predictions on each model's held-out fold.
* leaf pass: residual bucket summaries per (model, leaf) -> weighted
  residual quantile per leaf -> leaf value = eta * quantile.  Large frames: one
  row in ``SAMPLE_STEP`` says where to look, the next pass sums all rows below,
  inside and above that range, and a leaf whose quantile is outside is looked
  through whole; the value is exact in any case.
* update: a lazy pass adds the new trees to the predictions of the cells and
  sums gradients and losses by them for the next round; the frame is persisted
  and materialised by the next level pass, and cut from its lineage by a
  reliable ``checkpoint`` every few rounds.

Jobs per round = depth + 1, whatever the number of models.  Models are
split into chunks (extra passes) when their histograms would not fit the
per-task or driver budgets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir
from .binning import bin_matrix, n_bins
from .trees import (LEAF_PARTS, Split, Tree, best_split, child_bounds, leaf_part, project_monotone,
                    quantile_part, residual_bucket, route, uniform01)

# per-task dense histogram budget (bytes) and cells collected per pass;
# above DENSE_CELLS per model a level pass accumulates only touched cells
DENSE_CELLS = 1_000_000
TASK_HIST_BYTES = 256 << 20
DRIVER_CELLS = 20_000_000
# partial histograms (tasks x cells) summed on the driver instead of a shuffle
DRIVER_PARTIAL_CELLS = 1_000_000
# parent histograms kept on the driver for sibling subtraction (cells)
SUBTRACT_CELLS = 8_000_000
# rows of a block; a block whose cells have fewer rows on average keeps no sums by cell
BLOCK_ROWS = 1 << 20
MIN_CELL_ROWS = 4
# of rows that are sorted by cell, fold and label, one in so many is kept aside to find the ranges of the leaf values,
# which is done for frames of so many rows a task and for leaves with so many such rows
SAMPLE_STEP = 64
SAMPLE_ROWS = 1 << 18
SAMPLE_LEAST = 64
# parts of the ranges that such rows gave
RANGE_PARTS = 512
# buckets of a leaf pass over all leaves, and the least of one leaf
LEAF_CELLS = 1 << 20
LEAST_PARTS = 64
CELL_COLS = ["_bins", "_fold", "_size", "_segs"]
SAMPLE_COLS = ["_sy", "_sw"]
BLOCK_COLS = ["_y", "_w", "_rk", *CELL_COLS, *SAMPLE_COLS]
STATE_COLS = ["_pred", "_sums", "_loss"]
HIST_SCHEMA = "kind int, cell long, a double, b double, c double"
SPLIT_SCHEMA = ("model int, slot int, feature int, gain double, split_bin int, default_left boolean, w_left double, "
                "w_right double, cover_left double, cover_right double, cover double")
LEAF_SCHEMA = "leaf long, part double, sw double, mn double, mx double, n long"
KIND_HIST, KIND_VALID, KIND_TRAIN = 0, 1, 2


@dataclass(frozen=True)
class GrowParams:
    eta: float = 0.3
    max_depth: int = 6
    reg_lambda: float = 1.0
    alpha: float = 0.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0

    @classmethod
    def from_dict(cls, d: dict | None) -> "GrowParams":
        d = dict(d or {})
        alias = {"learning_rate": "eta", "lambda": "reg_lambda", "reg_alpha": "alpha",
                 "min_split_loss": "gamma"}
        ignored = {"objective", "tree_method", "verbosity", "quantile_alpha",
                   "monotone_constraints", "seed", "nthread", "n_jobs", "max_bin", "eval_metric"}
        kwargs = {}
        for k, v in d.items():
            k = alias.get(k, k)
            if k in ignored:
                continue
            if k not in cls.__dataclass_fields__:
                raise ValueError(f"unknown training parameter '{k}'")
            kwargs[k] = int(v) if k == "max_depth" else float(v)
        return cls(**kwargs)


@dataclass
class ModelSpec:
    model_id: int
    target: int
    quantile: float
    fold: int          # -1 = all rows (final model); k = rows of fold k held out
    group: int         # models with the same group share the CV curve
    params: GrowParams
    max_rounds: int


@dataclass
class ModelState:
    spec: ModelSpec
    base_score: float = 0.0
    trees: list = field(default_factory=list)
    active: bool = True
    train_curve: list = field(default_factory=list)   # loss after r trees, r = 0..
    valid_curve: list = field(default_factory=list)


@dataclass
class GroupResult:
    group: int
    best_round: int
    best_score: float
    curve: list


def _reduce_leaves(keys, sw, mn, mx, n):
    """Sum / min / max / sum per key (of one or two arrays) with one sort (no per-key Python)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = tuple(x[order] for x in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    starts = np.flatnonzero(new)
    return (tuple(x[starts] for x in keys), np.add.reduceat(sw[order], starts), np.minimum.reduceat(mn[order], starts),
            np.maximum.reduceat(mx[order], starts), np.add.reduceat(n[order], starts))


def _merge_leaves(parts):
    keys, *sums = zip(*parts)
    return _reduce_leaves(tuple(np.concatenate(x) for x in zip(*keys)), *(np.concatenate(x) for x in sums))


def _likely_ranges(found, quantile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf a range of residuals that holds the quantile but for a small chance, by the buckets of a sample.

    Three deviations of the weight up to the quantile wide, if rows were drawn at random; infinite for leaves with
    few of the rows.
    """
    lo, hi = np.full(len(quantile), -np.inf), np.full(len(quantile), np.inf)
    sw, mn, mx, n = (found[c].to_numpy() for c in ("sw", "mn", "mx", "n"))
    starts = np.searchsorted(found["leaf"].to_numpy(), np.arange(len(quantile) + 1))
    for i, q in enumerate(quantile):
        a, b = starts[i], starts[i + 1]
        rows, total = n[a:b].sum(), sw[a:b].sum()
        if rows < SAMPLE_LEAST or total <= 0:
            continue
        slack = 3.0 * np.sqrt(q * (1.0 - q) / rows) + 3.0 / rows
        lo[i] = mn[a + quantile_part(sw[a:b], 0.0, max(q - slack, 0.0) * total)[0]]
        hi[i] = mx[a + quantile_part(sw[a:b], 0.0, min(q + slack, 1.0) * total)[0]]
    return lo, hi


def _collected(df: DataFrame):
    """The rows in pandas, as Arrow batches whatever the session says of ``toPandas``."""
    return df.toArrow().to_pandas()


def _sum_cells(parts):
    u = np.concatenate([p[0] for p in parts])
    uu, inv = np.unique(u, return_inverse=True)
    return (uu,) + tuple(np.bincount(inv, np.concatenate([p[i] for p in parts]), len(uu)) for i in (1, 2, 3))


def _split_models(models: list[ModelState], n_features: int, n_bins: int, slots: int,
                  rows_per_task: int | None = None) -> list[list[ModelState]]:
    """Chunks of models whose histograms fit the per-task and driver budgets.

    Dense histograms cost nodes x features x bins per model; past
    ``DENSE_CELLS`` the pass keeps only touched cells, at most rows x
    features per task."""
    dense = max(1, slots) * n_features * n_bins
    per_model = dense if (dense <= DENSE_CELLS or not rows_per_task) else \
        min(dense, max(1, rows_per_task) * n_features)
    per_task = max(1, TASK_HIST_BYTES // (per_model * 3 * 8))
    per_driver = max(1, DRIVER_CELLS // dense)
    k = max(1, min(per_task, per_driver))
    return [models[i:i + k] for i in range(0, len(models), k)]


def binary_matrix(col: pa.Array, dtype, ncols: int) -> np.ndarray:
    """Zero-copy (n, ncols) view of a binary column whose values share one width."""
    n = len(col)
    if n == 0:
        return np.zeros((0, ncols), dtype)
    bufs = col.buffers()
    off_type = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(bufs[1], off_type)[col.offset: col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offs[0]: offs[-1]]
    return data.view(dtype).reshape(n, ncols)


def binary_array(mat: np.ndarray) -> pa.Array:
    """Binary column with one row of ``mat`` per value."""
    mat = np.ascontiguousarray(mat)
    n = mat.shape[0]
    width = mat.dtype.itemsize * (mat.shape[1] if mat.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets),
                                                  pa.py_buffer(mat.view(np.uint8).reshape(-1))])


def bins_dtype(n_bins: int):
    return np.uint8 if n_bins <= 256 else np.uint16


def _np(batch: pa.RecordBatch, name: str, dtype):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def batch_bins(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins (rows x features) of the feature values ``_x0..`` of a batch."""
    if not cuts:
        return np.zeros((batch.num_rows, 0), bins_dtype(n_bins(cuts)))
    return bin_matrix([_np(batch, f"_x{j}", np.float64) for j in range(len(cuts))], cuts, bins_dtype(n_bins(cuts)))


def _batch_arrays(batch: pa.RecordBatch, n_feat: int, n_targets: int, bdt, n_models: int, cuts=None):
    names = batch.schema.names
    bins = binary_matrix(batch.column(names.index("_bins")), bdt, n_feat) if "_bins" in names else batch_bins(batch, cuts)
    ys = np.stack([_np(batch, f"_y{t}", np.float64) for t in range(n_targets)], axis=1)
    w = _np(batch, "_w", np.float64)
    fold = _np(batch, "_fold", np.int64)
    rk = _np(batch, "_rk", np.int64) if "_rk" in names else np.zeros(batch.num_rows, np.int64)
    preds = binary_matrix(batch.column(names.index("_pred")), np.float64, n_models) \
        if "_pred" in names else None
    return bins, ys, w, fold, rk, preds


class Block:
    """Rows sorted by bin vector and fold, and by label inside a segment, for each target in an order of its own.

    ``ys``, ``ws`` and ``rks`` (targets x rows) by row, ``bins`` and ``preds`` by cell, ``fold`` and ``size`` (rows) by
    segment, ``segs`` the segments of each cell; ``sy`` and ``sw`` one row in ``SAMPLE_STEP``.  Passes that need no rows
    read none.
    """

    def __init__(self, ys, ws, rks, bins, fold, size, segs, preds=None, sums=None, loss=None, sample=None):
        self.ys, self.ws, self.rks, self.bins, self.fold, self.size, self.segs = ys, ws, rks, bins, fold, size, segs
        self.preds, self.sums, self.loss, self.sample = preds, sums, loss, sample
        self.start = np.cumsum(size) - size
        self.first = np.cumsum(segs) - segs
        self.rows = np.add.reduceat(size, self.first)
        self.n = int(size.sum())
        self._prefix, self._below = {}, {}

    @classmethod
    def of_rows(cls, bins, ys, w, fold, rk, preds=None) -> "Block":
        """Of arrays by row; rows of one cell have the same predictions."""
        bits, n = 8 * bins.dtype.itemsize, len(w)
        if bits * bins.shape[1] + 16 <= 64 and fold.max() < 1 << 16:
            key = np.zeros(n, np.uint64)
            for j in range(bins.shape[1]):
                key = key << np.uint64(bits) | bins[:, j].astype(np.uint64)
            order = np.argsort(key << np.uint64(16) | fold.astype(np.uint64), kind="stable")
        else:
            order = np.lexsort((fold, *bins.T[::-1]))
        bins, fold = bins[order], fold[order]
        cell = np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)]
        segment = cell | np.r_[True, fold[1:] != fold[:-1]]
        starts, cells = np.flatnonzero(segment), np.flatnonzero(cell)
        segs = np.diff(np.append(np.searchsorted(starts, cells), len(starts)))
        number = np.cumsum(segment)
        by_label = [order[np.lexsort((y[order], number))] for y in ys.T]
        rows = [np.stack([x[o] for x, o in zip(cols, by_label)]) for cols in (ys.T, [w] * len(by_label), [rk] * len(by_label))]
        return cls(*rows, bins[cells], fold[starts], np.diff(np.append(starts, n)), segs, None if preds is None else preds[order[cells]])

    def static(self, with_keys: bool) -> list[bytes]:
        """The columns ``BLOCK_COLS``."""
        one = slice(SAMPLE_STEP // 2, None, SAMPLE_STEP)
        return [x.tobytes() for x in (self.ys, self.ws, self.rks if with_keys else self.rks[:, :0], self.bins, self.fold.astype(np.int32),
                                      self.size.astype(np.int32), self.segs.astype(np.int32), self.ys[:, one], self.ws[:, one])]

    def by_row(self, per_cell: np.ndarray) -> np.ndarray:
        return np.repeat(per_cell, self.rows)

    def by_segment(self, per_cell: np.ndarray) -> np.ndarray:
        return np.repeat(per_cell, self.segs)

    def residuals(self, t: int, pos: int) -> np.ndarray:
        """Label less prediction of every row."""
        return self.ys[t] - self.by_row(self.preds[:, pos])

    def sampled(self, t: int, pos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Residual, weight and segment of one row in ``SAMPLE_STEP``."""
        segment = np.searchsorted(self.start, SAMPLE_STEP // 2 + SAMPLE_STEP * np.arange(self.sample.shape[2]), side="right") - 1
        y, w = self.sample[:, t]
        return y - self.by_segment(self.preds[:, pos])[segment], w, segment

    def upto(self, t: int, pred: np.ndarray, bound: np.ndarray, equal: bool, which: np.ndarray) -> np.ndarray:
        """Place of the first row of the segments ``which`` whose residual is above ``bound`` (``equal``) or not below it."""
        y = self.ys[t]
        lo = self.start[which]
        hi = lo + self.size[which]
        out, live = lo.copy(), np.arange(len(which))
        while len(live):
            mid = (lo + hi) >> 1
            r = y[np.minimum(mid, len(y) - 1)] - pred
            on = ((r <= bound) if equal else (r < bound)) & (lo < hi)
            lo, hi = np.where(on, mid + 1, lo), np.where(on | (lo >= hi), hi, mid)
            out[live] = lo
            more = lo < hi
            if more.sum() * 2 <= len(live):
                live, lo, hi, pred, bound = live[more], lo[more], hi[more], pred[more], bound[more]
        return out

    def prefix(self, t: int, labels: bool = False) -> np.ndarray:
        """Sums of weights (by labels) before each row and after the last, of more digits than the sums of a segment need."""
        if (t, labels) not in self._prefix:
            out = np.zeros(self.n + 1, np.longdouble)
            with np.errstate(over="ignore", invalid="ignore"):
                np.cumsum(self.ws[t] * self.ys[t] if labels else self.ws[t], dtype=np.longdouble, out=out[1:])
            self._prefix[t, labels] = out
        return self._prefix[t, labels]

    def below(self, t: int, pos: int) -> np.ndarray:
        """Place of the first label of each segment that is above the prediction."""
        if (t, pos) not in self._below:
            self._below[t, pos] = self.upto(t, self.by_segment(self.preds[:, pos]), np.zeros(len(self.size)), True, np.arange(len(self.size)))
        return self._below[t, pos]

    def parted(self, t: int, pos: int, labels: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights (by labels) of the rows of each segment up to the prediction, and above it."""
        total, at = self.prefix(t, labels), self.below(t, pos)
        return total[at] - total[self.start], total[self.start + self.size] - total[at]

    def gradients(self, t, q, mfold, sub, salt, pos) -> np.ndarray:
        """Sums of gradient and weight and the number of training rows of each cell: (3, cells)."""
        if sub < 1.0:
            kept = uniform01(self.rks[t], salt) < sub
            w = self.ws[t] * kept
            g = np.where(self.by_row(self.preds[:, pos]) >= self.ys[t], 1.0 - q, -q) * w
            out = np.stack([np.add.reduceat(x, self.start) for x in (g, w, kept.astype(np.float64))])
        else:
            upto, above = self.parted(t, pos)
            out = np.stack([(1.0 - q) * upto - q * above, upto + above, self.size]).astype(np.float64)
        if mfold >= 0:
            out[:, self.fold == mfold] = 0.0
        return np.add.reduceat(out, self.first, axis=1)

    def losses(self, t, q, mfold, pos) -> np.ndarray:
        """Pinball loss, weight and rows of the held-out rows and of the others."""
        held = self.fold == mfold if mfold >= 0 else np.zeros(len(self.fold), bool)
        upto, above = self.parted(t, pos)
        if np.isfinite(self.prefix(t, True)[-1]):
            pred = self.by_segment(self.preds[:, pos])
            y_upto, y_above = self.parted(t, pos, True)
            l = q * (y_above - pred * above) + (1.0 - q) * (pred * upto - y_upto)
        else:  # labels without a finite sum
            r = self.residuals(t, pos)
            l = np.add.reduceat(np.maximum(q * r, (q - 1.0) * r) * self.ws[t], self.start)
        by = np.stack([l, upto + above, self.size]).astype(np.float64)
        return np.stack([by[:, held].sum(axis=1), by[:, ~held].sum(axis=1)])


def _value(batch: pa.RecordBatch, name: str, i: int, dtype) -> np.ndarray:
    """Zero-copy view of value ``i`` of a binary column."""
    col = batch.column(batch.schema.get_field_index(name))
    off = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    a, b = off[col.offset + i], off[col.offset + i + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[a:b].view(dtype) if b > a else np.zeros(0, dtype)


def _blocks(it, n_feat: int, n_targets: int, bdt, n_models: int):
    """(batch, position, block) of every block; the rows of a batch that is not packed yet make up one."""
    for batch in it:
        names = batch.schema.names
        if batch.num_rows == 0:
            continue
        if "_size" not in names:
            yield batch, 0, Block.of_rows(*_batch_arrays(batch, n_feat, n_targets, bdt, n_models))
            continue
        for i in range(batch.num_rows):
            size, segs = (_value(batch, c, i, np.int32) for c in ("_size", "_segs"))
            ys, ws, rks = (_value(batch, c, i, kind).reshape(n_targets, -1) if c in names else None
                           for c, kind in (("_y", np.float64), ("_w", np.float64), ("_rk", np.int64)))
            block = Block(ys, ws, rks, _value(batch, "_bins", i, bdt).reshape(len(segs), n_feat), _value(batch, "_fold", i, np.int32),
                          size.astype(np.int64), segs.astype(np.int64))
            if "_sy" in names:
                block.sample = np.stack([_value(batch, c, i, np.float64).reshape(n_targets, -1) for c in SAMPLE_COLS])
            if "_pred" in names:
                block.preds = _value(batch, "_pred", i, np.float64).reshape(-1, n_models)
            if "_sums" in names:
                block.sums = _value(batch, "_sums", i, np.float64).reshape(-1, 3, len(segs))
                block.loss = _value(batch, "_loss", i, np.float64).reshape(-1, 2, 3)
            yield batch, i, block


def _record_batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def _salt(seed: int, model_id: int, rnd: int) -> int:
    return (seed * 1_000_003 + model_id * 7_919 + rnd * 104_729 + 17) & 0x7FFFFFFFFFFFFFFF


class Grower:
    def __init__(self, frame: DataFrame, n_features: int, n_bins: int, n_targets: int,
                 constraints: list[int], specs: list[ModelSpec], scales: list[float],
                 seed: int = 42, early_stopping_rounds: int | None = 10,
                 checkpoint_interval: int = 10, callback=None, leaf_parts: int = LEAF_PARTS, cuts: list[np.ndarray] | None = None):
        self.spark = frame.sparkSession
        self.frame = frame
        self.F = n_features
        self.B1 = n_bins
        self.T = n_targets
        self.constraints = np.asarray(list(constraints) + [0] * (n_features - len(constraints)),
                                      np.int64)[:n_features]
        self.models = [ModelState(s) for s in specs]
        self.scales = scales
        self.seed = seed
        self.early = early_stopping_rounds
        self.ckpt_every = checkpoint_interval
        self.callback = callback or (lambda msg, data=None: None)
        self.groups: dict[int, GroupResult] = {}
        self.jobs = 0
        self.leaf_parts = leaf_parts
        self.cuts = cuts  # of frames that hold values instead of bins
        self.summed: dict[int, int] = {}  # models whose sums and losses the frame of the round holds, by position
        self.all_summed = False  # every block of the frame keeps sums by cell
        self.rows_per_task = None  # set by the caller when known (sparse chunk sizing, samples)

    # ------------------------------------------------------------------ passes
    def _partitions(self, frame: DataFrame) -> int:
        if not hasattr(self, "_nparts"):
            self._nparts = frame.rdd.getNumPartitions()
        return self._nparts

    def _columns(self, frame: DataFrame, state: bool) -> list[str]:
        """What a pass reads: the packed columns, or the rows."""
        if "_size" in frame.columns:
            return BLOCK_COLS + (STATE_COLS if state else [])
        rk = ["_rk"] if "_rk" in frame.columns else []
        bins = ["_bins"] if "_bins" in frame.columns else [f"_x{j}" for j in range(self.F)]
        return rk + ["_fold", "_w"] + [f"_y{t}" for t in range(self.T)] + bins + (["_pred"] if state else [])

    def _pack(self, frame: DataFrame) -> DataFrame:
        """The rows in blocks; the row keys only if some model samples rows by them."""
        F_, T_, bdt, cuts = self.F, self.T, bins_dtype(self.B1), self.cuts
        keyed = any(st.spec.params.subsample < 1.0 for st in self.models)

        def emit(held):
            arrays = (np.concatenate(x) for x in zip(*held))
            cols = Block.of_rows(*arrays).static(keyed)
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=BLOCK_COLS)

        def fn(it):
            held, n = [], 0
            for batch in it:
                if batch.num_rows == 0:
                    continue
                # copies: views would keep the batches they come from
                held.append([np.array(x) for x in _batch_arrays(batch, F_, T_, bdt, 0, cuts)[:5]])
                n += batch.num_rows
                if n >= BLOCK_ROWS:
                    yield emit(held)
                    held, n = [], 0
            if held:
                yield emit(held)

        read = [c for c in self._columns(frame, False) if keyed or c != "_rk"]
        return frame.select(*read).mapInArrow(fn, ", ".join(f"{c} binary" for c in BLOCK_COLS))

    def _level_pass(self, frame: DataFrame, chunk: list[ModelState], depth: int, rnd: int,
                    with_loss: bool, trees: dict[int, Tree], build: dict[int, list[int]] | None = None,
                    allowed: dict[int, np.ndarray] | None = None):
        """Histograms of the ``build`` nodes of each model (default: its whole
        frontier at ``depth``) and, with ``with_loss``, the pinball losses of
        the current predictions.  Returns ({model: {node: (3, F, B1)}}, losses);
        with ``allowed`` (features of each model) the splits are chosen by the
        executors, and the first part is {model: {node: (cover, Split or None)}}."""
        F_, B1, T_ = self.F, self.B1, self.T
        seed = self.seed
        plan = []
        built_nodes = {}
        for st in chunk:
            sp = st.spec
            tree = trees.get(sp.model_id)
            if tree is not None:
                frontier = (build or {}).get(sp.model_id, tree.frontier(depth))
                slot = np.full(tree.n_nodes, -1, np.int64)
                slot[frontier] = np.arange(len(frontier))
                arr = tree.arrays()
            else:
                frontier, slot, arr = [], None, None
            built_nodes[sp.model_id] = list(frontier)
            plan.append((sp.model_id, sp.target, sp.quantile, sp.fold, sp.params.subsample,
                         _salt(seed, sp.model_id, rnd), arr, slot, len(frontier)))
        offsets, off = [], 0
        for p in plan:
            offsets.append(off)
            off += max(p[8], 0) * F_ * B1
        index = {st.spec.model_id: i for i, st in enumerate(self.models)}
        pred_pos = [index[p[0]] for p in plan]
        kept = [self.summed.get(pos) for pos in pred_pos]
        bdt, M = bins_dtype(B1), len(self.models)

        def fn(it):
            acc = [None] * len(plan)
            sparse: dict[int, list] = {}
            loss = np.zeros((len(plan), 2, 3))
            for _, _, block in _blocks(it, F_, T_, bdt, M):
                for k, (mid, t, q, mfold, sub, salt, arr, slot, nslots) in enumerate(plan):
                    if with_loss:
                        loss[k] += block.loss[kept[k]] if block.loss is not None else block.losses(t, q, mfold, pred_pos[k])
                    if arr is None or nslots == 0:
                        continue
                    s = slot[route(arr, block.bins, depth)]
                    if not (s >= 0).any():
                        continue
                    g, h, n = block.sums[kept[k]] if block.sums is not None and len(block.sums) else \
                        block.gradients(t, q, mfold, sub, salt, pred_pos[k])
                    at = np.flatnonzero((s >= 0) & (n > 0))
                    if not len(at):
                        continue
                    g, h, n = g[at], h[at], n[at]
                    base = (s[at] * F_)[:, None] + np.arange(F_)[None, :]
                    keys = (base * B1 + block.bins[at]).ravel()
                    size = nslots * F_ * B1
                    if size <= DENSE_CELLS:
                        G = np.bincount(keys, np.repeat(g, F_), size)
                        H = np.bincount(keys, np.repeat(h, F_), size)
                        N = np.bincount(keys, np.repeat(n, F_), size)
                        if acc[k] is None:
                            acc[k] = [G, H, N]
                        else:
                            acc[k][0] += G
                            acc[k][1] += H
                            acc[k][2] += N
                    else:
                        # deep levels: only the cells this batch touches (memory
                        # bounded by rows x features, not nodes x features x bins)
                        u, inv = np.unique(keys, return_inverse=True)
                        part = (u, np.bincount(inv, np.repeat(g, F_)), np.bincount(inv, np.repeat(h, F_)),
                                np.bincount(inv, np.repeat(n, F_)))
                        sparse.setdefault(k, []).append(part)
                        if sum(len(x[0]) for x in sparse[k]) > 4 * DENSE_CELLS:
                            sparse[k] = [_sum_cells(sparse[k])]
            kinds, cells, a_, b_, c_ = [], [], [], [], []
            for k, a in enumerate(acc):
                if a is not None:
                    nz = np.flatnonzero(a[2])
                    kinds.append(np.full(len(nz), KIND_HIST, np.int32))
                    cells.append(nz + offsets[k])
                    a_.append(a[0][nz])
                    b_.append(a[1][nz])
                    c_.append(a[2][nz])
            for k, parts in sparse.items():
                u, G, H, N = _sum_cells(parts)
                kinds.append(np.full(len(u), KIND_HIST, np.int32))
                cells.append(u + offsets[k])
                a_.append(G)
                b_.append(H)
                c_.append(N)
            if with_loss:
                for k in range(len(plan)):
                    for j, kind in ((0, KIND_VALID), (1, KIND_TRAIN)):
                        kinds.append(np.array([kind], np.int32))
                        cells.append(np.array([k], np.int64))
                        a_.append(loss[k, j, :1])
                        b_.append(loss[k, j, 1:2])
                        c_.append(loss[k, j, 2:3])
            if kinds:
                yield _record_batch(kind=np.concatenate(kinds), cell=np.concatenate(cells).astype(np.int64),
                                    a=np.concatenate(a_), b=np.concatenate(b_), c=np.concatenate(c_))

        read = CELL_COLS + ["_sums", "_loss"] if self.all_summed else self._columns(frame, True)
        partials = frame.select(*read).mapInArrow(fn, HIST_SCHEMA)
        if allowed is not None:
            return self._distributed_splits(partials, plan, offsets, built_nodes, trees, allowed, with_loss)
        if self._few_cells(frame, off):
            # few tasks x few cells: the partial histograms are smaller than a
            # shuffle stage's overhead, so they are summed on the driver
            res = _collected(partials).groupby(["kind", "cell"], as_index=False)[["a", "b", "c"]].sum()
        else:
            res = _collected(partials.groupBy("kind", "cell")
                             .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")))
        self.jobs += 1
        hists, losses = {}, {}
        kinds = res["kind"].to_numpy(np.int64)
        cells = res["cell"].to_numpy(np.int64)
        vals = res[["a", "b", "c"]].to_numpy(np.float64).reshape(-1, 3)
        for k, p in enumerate(plan):
            if with_loss:
                for kind, tgt in ((KIND_VALID, 0), (KIND_TRAIN, 1)):
                    sel = (kinds == kind) & (cells == k)
                    v = vals[sel].sum(axis=0) if sel.any() else np.zeros(3)
                    losses.setdefault(p[0], [None, None])[tgt] = v
            if p[8] > 0:
                size = p[8] * F_ * B1
                sel = (kinds == KIND_HIST) & (cells >= offsets[k]) & (cells < offsets[k] + size)
                dense = np.zeros((3, size))
                dense[:, cells[sel] - offsets[k]] = vals[sel].T
                dense = dense.reshape(3, p[8], F_, B1)
                hists[p[0]] = {node: dense[:, i] for i, node in enumerate(built_nodes[p[0]])}
        return hists, losses

    def _few_cells(self, frame: DataFrame, cells: int) -> bool:
        return self._partitions(frame) * max(cells, 1) <= DRIVER_PARTIAL_CELLS

    def _distributed_splits(self, partials: DataFrame, plan, offsets, built_nodes, trees, allowed, with_loss: bool):
        """Best split of every node of a level, chosen in the executors.

        Returns ({model: {node: (cover, Split or None)}}, losses).
        """
        F_, B1, constraints = self.F, self.B1, self.constraints
        params = {st.spec.model_id: st.spec.params for st in self.models}
        starts = np.asarray(offsets, np.int64)
        nodes = [[(trees[p[0]].lower[n], trees[p[0]].upper[n]) for n in built_nodes[p[0]]] if p[8] else [] for p in plan]
        wanted = [(p[0], params[p[0]], allowed[p[0]] if p[8] else None) for p in plan]

        def choose(it):
            """Best split of each run of cells of one (model, node, feature)."""
            held = None
            for batch in it:
                part = np.stack([_np(batch, "cell", np.int64).astype(np.float64), *(_np(batch, c, np.float64) for c in "ab")])
                held = part if held is None else np.concatenate([held, part], axis=1)
                group = held[0].astype(np.int64) // B1
                cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
                if cut:
                    yield emit(held[:, :cut])
                    held = held[:, cut:]
            if held is not None and held.shape[1]:
                yield emit(held)

        def emit(part):
            cells = part[0].astype(np.int64)
            group = cells // B1
            rows = []
            for lo, hi in zip(*(lambda s: (s, np.append(s[1:], len(group))))(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))):
                g, h = np.zeros((1, B1)), np.zeros((1, B1))
                bins = cells[lo:hi] % B1
                g[0, bins], h[0, bins] = part[1, lo:hi], part[2, lo:hi]
                k = int(np.searchsorted(starts, cells[lo], side="right")) - 1
                while not nodes[k]:  # models without nodes at this level share an offset
                    k -= 1
                slot, feature = divmod((cells[lo] - starts[k]) // B1, F_)
                mid, p, usable = wanted[k]
                cover = h.sum()
                found = best_split(g, h, usable[feature:feature + 1], constraints[feature:feature + 1], *nodes[k][slot],
                                   p.reg_lambda, p.alpha, p.min_child_weight, p.gamma) if cover > 0 else None
                rows.append((mid, int(slot), int(feature), *((found.gain, found.split_bin, found.default_left, found.weight_left,
                             found.weight_right, found.cover_left, found.cover_right) if found else (None,) * 7), float(cover)))
            names = [x.split()[0] for x in SPLIT_SCHEMA.split(", ")]
            kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
            types = [kinds[x.split()[1]] for x in SPLIT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        summed = partials.groupBy("kind", "cell").agg(*[F.sum(c).alias(c) for c in "abc"])
        if with_loss:  # read twice: the losses and the splits
            summed = summed.persist(StorageLevel.MEMORY_AND_DISK)
        group = F.floor(F.col("cell") / B1)
        per_feature = (summed.filter(F.col("kind") == KIND_HIST).select("cell", "a", "b").repartition(group)
                       .sortWithinPartitions("cell").mapInArrow(choose, SPLIT_SCHEMA))
        # the largest gain wins, of equal gains missing left and then the first feature; each feature has the node's whole weight
        best = F.max(F.struct(F.col("gain").isNotNull().alias("found"), "gain", "default_left", (-F.col("feature")).alias("first"),
                              *[F.col(c) for c in ("split_bin", "w_left", "w_right", "cover_left", "cover_right")]))
        rows = per_feature.groupBy("model", "slot").agg(F.max("cover").alias("cover"), best.alias("best")).collect()
        self.jobs += 1
        splits: dict[int, dict[int, tuple]] = {}
        for r in rows:
            b = r["best"]
            split = Split(-1, -b["first"], b["split_bin"], b["default_left"], b["gain"], b["w_left"], b["w_right"],
                          b["cover_left"], b["cover_right"]) if b["found"] else None
            splits.setdefault(r["model"], {})[built_nodes[r["model"]][r["slot"]]] = (r["cover"], split)
        losses = {}
        if with_loss:
            for r in summed.filter(F.col("kind") != KIND_HIST).collect():
                losses.setdefault(plan[r["cell"]][0], [None, None])[0 if r["kind"] == KIND_VALID else 1] = np.array([r["a"], r["b"], r["c"]])
            summed.unpersist()
        return splits, losses

    def _leaf_plan(self, chunk: list[ModelState], trees: dict[int, Tree], rnd: int):
        """What a leaf pass needs of every model, and the number of leaves, which are numbered over all models."""
        index = {st.spec.model_id: i for i, st in enumerate(self.models)}
        plan, first = [], 0
        for st in chunk:
            sp = st.spec
            tree = trees[sp.model_id]
            leaves = tree.leaves()
            number = np.full(tree.n_nodes, -1, np.int64)
            number[leaves] = first + np.arange(len(leaves))
            plan.append((sp.target, sp.fold, sp.params.subsample if rnd >= 0 else 1.0, _salt(self.seed, sp.model_id, rnd),
                         tree.arrays(), number, max(tree.depth), self.scales[sp.target], index[sp.model_id], first, len(leaves)))
            first += len(leaves)
        return plan, first

    def _parts(self, n_leaves: int) -> int:
        """Buckets of one leaf: fewer where there are many leaves; the values do not depend on it."""
        return min(self.leaf_parts, max(LEAST_PARTS, LEAF_CELLS // max(n_leaves, 1)))

    def _leaf_pass(self, frame: DataFrame, chunk: list[ModelState], plan, n_leaves: int, rnd: int, with_pred: bool,
                   brackets=None, sample: bool = False, parts: int | None = None):
        """Sorted ``(leaf, part, weight, smallest, largest, rows)`` of residuals, of those inside ``brackets`` if given.

        ``brackets``: of each leaf the smallest and the largest residual, whether to tell single values and whether
        the rows below (part -1) and above (part ``inf``) are summed too.  ``sample``: only the rows kept aside.
        """
        F_, T_, P = self.F, self.T, parts or self._parts(n_leaves)
        bdt, M = bins_dtype(self.B1), len(self.models)

        def fn(it):
            dense = [None] * len(plan)
            parts = []
            held = 0
            for _, _, block in _blocks(it, F_, T_, bdt, M):
                if not with_pred:
                    block.preds = np.zeros((len(block.bins), M))
                for k, (t, mfold, sub, salt, arr, number, depth, scale, pos, first, count) in enumerate(plan):
                    node = route(arr, block.bins, depth) if depth > 0 else np.zeros(len(block.bins), np.int64)
                    # held-out rows belong to one leaf more, which is dropped
                    leaf = block.by_segment(number[node] - first)
                    if mfold >= 0:
                        leaf = np.where(block.fold == mfold, count, leaf)
                    if brackets is None:
                        if sample:
                            r, w, segment = block.sampled(t, pos)
                            key = residual_bucket(r, scale, P) + leaf[segment] * P
                        else:
                            r, w = block.residuals(t, pos), block.ws[t]
                            key = residual_bucket(r, scale, P) + np.repeat(leaf * P, block.size)
                        if sub < 1.0:
                            key[uniform01(block.rks[t], salt) >= sub] = count * P
                        size = (count + 1) * P
                        if dense[k] is None:
                            dense[k] = [np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.int64)]
                        sw, mn, mx, n = dense[k]
                        sw += np.bincount(key, w, size)
                        n += np.bincount(key, None, size)
                        np.minimum.at(mn, key, r)
                        np.maximum.at(mx, key, r)
                        continue
                    lo, hi, whole, outside = (x[first:first + count] for x in brackets)
                    which = np.flatnonzero(np.append(lo <= hi, False)[leaf])
                    if not len(which):
                        continue
                    mine, pred = leaf[which], block.by_segment(block.preds[:, pos])[which]
                    begin, end = block.start[which], block.start[which] + block.size[which]
                    a, b = block.upto(t, pred, lo[mine], False, which), block.upto(t, pred, hi[mine], True, which)
                    if outside.any():
                        total = block.prefix(t)
                        for part, x, y in ((-1.0, begin, a), (np.inf, b, end)):
                            at = np.flatnonzero((y > x) & outside[mine])
                            sw = np.bincount(mine[at], (total[y[at]] - total[x[at]]).astype(np.float64), count)
                            n = np.bincount(mine[at], y[at] - x[at], count).astype(np.int64)
                            at = np.flatnonzero(n)
                            edge = np.full(len(at), part)
                            parts.append(((at + first, edge), sw[at], edge, edge, n[at]))
                    inside = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                    mine, pred = np.repeat(mine, b - a), np.repeat(pred, b - a)
                    if sub < 1.0:
                        kept = uniform01(block.rks[t][inside], salt) < sub
                        inside, mine, pred = inside[kept], mine[kept], pred[kept]
                    if len(inside):
                        r = block.ys[t][inside] - pred
                        keys = (mine + first, leaf_part(r, lo[mine], hi[mine], whole[mine], scale, P))
                        parts.append(_reduce_leaves(keys, block.ws[t][inside], r, r, np.ones(len(r), np.int64)))
                        held += len(parts[-1][1])
                if held > 4_000_000:  # keep the buffer bounded
                    parts = [_merge_leaves(parts)]
                    held = len(parts[0][1])
            for k, found in enumerate(dense):
                if found is not None:
                    sw, mn, mx, n = found
                    at = np.flatnonzero(n[:-P])
                    leaf, part = np.divmod(at, P)
                    yield _record_batch(leaf=leaf + plan[k][9], part=part.astype(np.float64), sw=sw[at], mn=mn[at], mx=mx[at], n=n[at])
            if parts:
                (leaf, part), sw, mn, mx, n = _merge_leaves(parts)
                yield _record_batch(leaf=leaf.astype(np.int64), part=part.astype(np.float64), sw=sw, mn=mn, mx=mx, n=n)

        read = CELL_COLS + SAMPLE_COLS + (["_pred"] if with_pred else []) if sample else self._columns(frame, with_pred)
        partials = frame.select(*read).mapInArrow(fn, LEAF_SCHEMA)
        # each task emits at most min(parts, its rows x models) summaries
        off = n_leaves * P
        bound = self._partitions(frame) * min(max(off, 1), (self.rows_per_task or off) * len(plan))
        if bound <= DRIVER_PARTIAL_CELLS:
            res = (_collected(partials).groupby(["leaf", "part"], as_index=False)
                   .agg(sw=("sw", "sum"), mn=("mn", "min"), mx=("mx", "max"), n=("n", "sum")))
        else:
            res = _collected(partials.groupBy("leaf", "part")
                             .agg(F.sum("sw").alias("sw"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
                                  F.sum("n").alias("n")))
        self.jobs += 1
        return res.sort_values(["leaf", "part"])

    def _leaf_values(self, frame: DataFrame, chunk: list[ModelState], trees: dict[int, Tree], rnd: int,
                     with_pred: bool = True) -> dict[int, dict[int, float]]:
        """T-6: weighted quantile of the residuals of every leaf, per model: one of the residuals themselves.

        The first pass sums weights per bucket and finds the one that holds
        the quantile; of large frames it looks where the rows kept aside say, and sums the rows below and above.
        Further passes look into the chosen buckets alone:
        at their single values if they hold no more rows than a leaf has parts, at
        as many equal parts of their range otherwise, until one value is left.
        """
        plan, n_leaves = self._leaf_plan(chunk, trees, rnd)
        quantile = np.concatenate([np.full(len(trees[st.spec.model_id].leaves()), st.spec.quantile) for st in chunk])
        value, before, total = np.zeros(n_leaves), np.zeros(n_leaves), np.zeros(n_leaves)
        lo, hi, rows = np.full(n_leaves, np.inf), np.full(n_leaves, -np.inf), np.zeros(n_leaves, np.int64)
        open_leaves, brackets, fresh = np.arange(n_leaves), None, np.ones(n_leaves, bool)
        parts = self._parts(n_leaves)
        if "_size" in frame.columns and (self.rows_per_task or 0) >= SAMPLE_ROWS and all(p[2] == 1.0 for p in plan):
            found = self._leaf_pass(frame, chunk, plan, n_leaves, rnd, with_pred, sample=True)
            brackets = (*_likely_ranges(found, quantile), np.zeros(n_leaves, bool), fresh.copy())
            parts = min(parts, RANGE_PARTS)
        while len(open_leaves):
            res = self._leaf_pass(frame, chunk, plan, n_leaves, rnd, with_pred, brackets, parts=parts)
            part, sw, mn, mx, n = (res[c].to_numpy() for c in ("part", "sw", "mn", "mx", "n"))
            starts = np.searchsorted(res["leaf"].to_numpy(), np.arange(n_leaves + 1))
            left = []
            for i in open_leaves:
                a, b = starts[i], starts[i + 1]
                if fresh[i]:
                    total[i] = sw[a:b].sum()
                if total[i] <= 0:  # no row, or none with a weight
                    continue
                k, ahead = quantile_part(sw[a:b], before[i], quantile[i] * total[i])
                if fresh[i] and brackets is not None and (part[a + k] == -1.0 or part[a + k] == np.inf):
                    lo[i], hi[i] = -np.inf, np.inf  # not where the sample said
                    left.append(i)
                    continue
                before[i], fresh[i] = ahead, False
                value[i], lo[i], hi[i], rows[i] = mn[a + k], mn[a + k], mx[a + k], n[a + k]
                if lo[i] < hi[i]:
                    left.append(i)
            open_leaves = np.asarray(left, np.int64)
            closed = np.ones(n_leaves, bool)
            closed[open_leaves] = False
            lo[closed], hi[closed] = np.inf, -np.inf
            brackets = (lo, hi, ~fresh & (rows <= parts), fresh & ~closed)
        numbers = {st.spec.model_id: p[5] for st, p in zip(chunk, plan)}
        return {mid: {leaf: float(value[number[leaf]]) for leaf in trees[mid].leaves()} for mid, number in numbers.items()}

    # ------------------------------------------------------------------ driver
    def _grow_round(self, frame: DataFrame, active: list[ModelState], rnd: int):
        trees = {st.spec.model_id: Tree() for st in active}
        max_depth = max(st.spec.params.max_depth for st in active)
        losses = {}
        rng_cols = {}
        for st in active:
            sp = st.spec
            allowed = np.ones(self.F, bool)
            if sp.params.colsample_bytree < 1.0 and self.F > 1:
                rng = np.random.default_rng(_salt(self.seed, sp.model_id, rnd))
                k = max(1, int(round(sp.params.colsample_bytree * self.F)))
                allowed[:] = False
                allowed[rng.choice(self.F, size=k, replace=False)] = True
            rng_cols[sp.model_id] = allowed
        parent_hist: dict[int, dict[int, np.ndarray]] = {}
        for depth in range(max_depth):
            growing = [st for st in active
                       if depth < st.spec.params.max_depth and trees[st.spec.model_id].frontier(depth)]
            if not growing:
                break
            with_loss = depth == 0  # every active model still has its root here
            build, derive = self._plan_subtraction(growing, trees, depth, parent_hist)
            level_hist: dict[int, dict[int, np.ndarray]] = {}
            for chunk in _split_models(growing, self.F, self.B1, 2 ** depth, self.rows_per_task):
                own = {st.spec.model_id: trees[st.spec.model_id] for st in chunk}
                cells = sum(len(own[m].frontier(depth)) for m in own) * self.F * self.B1
                if not self._few_cells(frame, cells):
                    splits, ls = self._level_pass(frame, chunk, depth, rnd, with_loss, own, None, rng_cols)
                    losses.update(ls)
                    for mid, found in splits.items():
                        for node in sorted(found):
                            self._apply_split(own[mid], node, *found[node])
                    continue
                hists, ls = self._level_pass(frame, chunk, depth, rnd, with_loss, own, build)
                losses.update(ls)
                for st in chunk:
                    mid = st.spec.model_id
                    h = hists.get(mid, {})
                    for node, (parent, sibling) in derive.get(mid, {}).items():
                        h[node] = parent_hist[mid][parent] - h[sibling]
                    level_hist[mid] = h
                    self._split_level(st, trees[mid], h, depth, rng_cols[mid])
            keep = sum(len(v) for v in level_hist.values()) * self.F * self.B1 <= SUBTRACT_CELLS
            parent_hist = level_hist if keep else {}
        # leaf values
        for chunk in _split_models(active, 1, min(self.leaf_parts, 4 * LEAST_PARTS), 2 ** max_depth):
            values = self._leaf_values(frame, chunk, trees, rnd)
            for st in chunk:
                tree = trees[st.spec.model_id]
                for leaf, val in values[st.spec.model_id].items():
                    tree.value[leaf] = st.spec.params.eta * val
                project_monotone(tree, self.constraints)
        return trees, losses

    def _plan_subtraction(self, growing, trees, depth, parent_hist):
        """Per model: nodes to build from rows, and (parent, sibling) for nodes
        derived as parent - sibling (the larger child of each split)."""
        build, derive = {}, {}
        for st in growing:
            mid = st.spec.model_id
            tree = trees[mid]
            frontier = tree.frontier(depth)
            if depth == 0 or mid not in parent_hist:
                build[mid] = frontier
                continue
            fset = set(frontier)
            b, d = [], {}
            for parent, hist in parent_hist[mid].items():
                l, r = tree.left[parent], tree.right[parent]
                if l < 0 or l not in fset or r not in fset:
                    continue
                small, large = (l, r) if tree.cover[l] <= tree.cover[r] else (r, l)
                b.append(small)
                d[large] = (parent, small)
            covered = set(b) | set(d)
            b += [n for n in frontier if n not in covered]
            build[mid], derive[mid] = sorted(b), d
        return build, derive

    def _split_level(self, st: ModelState, tree: Tree, hist: dict, depth: int, allowed):
        if not hist:
            return
        p = st.spec.params
        for node in tree.frontier(depth):
            if node not in hist:
                continue
            G, H = hist[node][0], hist[node][1]
            cover = float(H[0].sum())
            sp = best_split(G, H, allowed, self.constraints, tree.lower[node], tree.upper[node],
                            p.reg_lambda, p.alpha, p.min_child_weight, p.gamma) if cover > 0 else None
            self._apply_split(tree, node, cover, sp)

    def _apply_split(self, tree: Tree, node: int, cover: float, sp: Split | None) -> None:
        if cover <= 0:
            return
        tree.cover[node] = cover
        if sp is None:
            return
        bl, br = child_bounds(sp, int(self.constraints[sp.feature]), tree.lower[node], tree.upper[node])
        tree.add_children(node, sp.feature, sp.split_bin, sp.default_left, sp.gain, bl, br, sp.cover_left, sp.cover_right)

    def _base_scores(self, frame: DataFrame):
        stumps = {st.spec.model_id: Tree() for st in self.models}
        values = {}
        for chunk in _split_models(self.models, 1, self.leaf_parts, 1):
            values.update(self._leaf_values(frame, chunk, stumps, rnd=-1, with_pred=False))
        for st in self.models:
            st.base_score = values[st.spec.model_id][0]

    def _record_losses(self, losses, rnd_done: int):
        for st in self.models:
            if not st.active or st.spec.model_id not in losses:
                continue
            v, t = losses[st.spec.model_id]
            if v is not None and st.spec.fold >= 0 and v[1] > 0:
                st.valid_curve.append(v[0] / v[1])
            if t is not None and t[1] > 0:
                st.train_curve.append(t[0] / t[1])

    def _check_groups(self, rnd_done: int) -> None:
        """Early stopping per group on the mean held-out loss over its folds."""
        by_group: dict[int, list[ModelState]] = {}
        for st in self.models:
            by_group.setdefault(st.spec.group, []).append(st)
        for g, members in by_group.items():
            if g in self.groups:
                continue
            # a fold that no row falls in has no curve: the others decide
            folds = [m for m in members if m.spec.fold >= 0 and m.valid_curve]
            max_rounds = max(m.spec.max_rounds for m in members)
            if not folds:
                if rnd_done >= max_rounds:
                    self.groups[g] = GroupResult(g, max_rounds, float("nan"), [])
                    for m in members:
                        m.active = False
                continue
            n = min(len(m.valid_curve) for m in folds)
            # curve[r] = mean loss after r trees; rounds are 1-based
            curve = [float(np.mean([m.valid_curve[r] for m in folds])) for r in range(1, n)]
            if not curve:
                continue
            best = int(np.argmin(curve))
            stop = (self.early is not None and len(curve) - 1 - best >= self.early) \
                or len(curve) >= max_rounds
            if stop:
                self.groups[g] = GroupResult(g, best + 1, curve[best], curve)
                for m in members:
                    m.active = False
                self.callback(f"group {g}: best round {best + 1}, score {curve[best]:.4f}",
                              {"stage": "cv_end", "group": g, "best_round": best + 1,
                               "best_score": curve[best]})

    def fit(self, max_rounds: int):
        ensure_checkpoint_dir(self.spark)
        frame = self._pack(self.frame).persist(StorageLevel.MEMORY_AND_DISK)
        persisted = [frame]
        try:
            self._base_scores(frame)  # also the pass that materialises the blocks
            if getattr(self, "on_materialised", None):
                self.on_materialised()
            # no pass over levels needs the rows then
            of_cells = F.length("_w") / (8 * self.T) >= float(MIN_CELL_ROWS) * F.length("_segs") / 4
            self.all_summed = frame.agg(F.min(of_cells)).first()[0] is True
            base = np.asarray([st.base_score for st in self.models], np.float64)
            frame = self._advance(frame, {}, self.models, 0, base).persist(StorageLevel.MEMORY_AND_DISK)
            persisted.append(frame)
            self._boost(frame, max_rounds, persisted)
        finally:  # also when the jobs are cancelled
            for f_ in persisted:
                f_.unpersist()
        # groups that never stopped (rounds exhausted without a loss pass)
        self._check_groups(max_rounds)
        return self

    def _boost(self, frame: DataFrame, max_rounds: int, persisted: list) -> None:
        """The rounds; ``persisted`` holds the frames that are kept at the time."""
        for rnd in range(max_rounds + 1):
            active = [st for st in self.models if st.active]
            if not active:
                break
            if rnd == max_rounds:  # loss of the final predictions only
                _, losses = self._level_pass(frame, active, 0, rnd, True, {})
                self._record_losses(losses, rnd)
                self._check_groups(rnd)
                break
            trees, losses = self._grow_round(frame, active, rnd)
            while len(persisted) > 1:  # the passes have materialised the last one
                persisted.pop(0).unpersist()
            self._record_losses(losses, rnd)
            self._check_groups(rnd)
            still = [st for st in active if st.active]
            for st in active:
                st.trees.append(trees[st.spec.model_id])
            if not still:
                break
            frame = self._advance(frame, {st.spec.model_id: trees[st.spec.model_id] for st in still}, still, rnd + 1)
            if self.ckpt_every and (rnd + 1) % self.ckpt_every == 0 and rnd + 1 < max_rounds:
                frame = frame.checkpoint(eager=True)
                self.jobs += 1
            else:
                frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
            persisted.append(frame)

    def _advance(self, frame: DataFrame, trees: dict[int, Tree], models: list[ModelState], rnd: int,
                 base: np.ndarray | None = None) -> DataFrame:
        """The blocks with ``trees`` added to the predictions (``base`` at the start), and what round ``rnd`` needs of ``models``:
        losses, and sums of gradients by cell where cells have several rows."""
        F_, T_ = self.F, self.T
        index = {st.spec.model_id: i for i, st in enumerate(self.models)}
        plan = [(index[mid], t.arrays(), max(t.depth)) for mid, t in trees.items()]
        wanted = [(st.spec.target, st.spec.quantile, st.spec.fold, st.spec.params.subsample,
                   _salt(self.seed, st.spec.model_id, rnd), index[st.spec.model_id]) for st in models]
        self.summed = {w[5]: k for k, w in enumerate(wanted)}
        bdt, M = bins_dtype(self.B1), len(self.models)

        def fn(it):
            for batch, i, block in _blocks(it, F_, T_, bdt, M):
                cells = len(block.bins)
                preds = np.tile(base, (cells, 1)) if base is not None else block.preds.copy()
                for pos, arr, depth in plan:
                    node = route(arr, block.bins, depth) if depth > 0 else np.zeros(cells, np.int64)
                    preds[:, pos] += arr["value"][node]
                block.preds = preds
                sums = np.stack([block.gradients(*w) for w in wanted]) if cells * MIN_CELL_ROWS <= block.n else np.zeros(0)
                loss = np.stack([block.losses(t, q, mfold, pos) for t, q, mfold, _, _, pos in wanted])
                cols = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in BLOCK_COLS]
                cols += [pa.array([x.tobytes()], pa.binary()) for x in (preds, sums, loss)]
                yield pa.RecordBatch.from_arrays(cols, names=BLOCK_COLS + STATE_COLS)

        schema = ", ".join(f"{c} binary" for c in BLOCK_COLS + STATE_COLS)
        return frame.select(*self._columns(frame, base is None)).mapInArrow(fn, schema)

    # ------------------------------------------------------------------ output
    def results(self):
        out = []
        for st in self.models:
            g = self.groups.get(st.spec.group)
            best = g.best_round if g else len(st.trees)
            out.append((st, best, g.best_score if g else float("nan")))
        return out


def make_specs(n_targets: int, quantiles: list[float], params_list: list[GrowParams],
               nfold: int, max_rounds: int, with_final: bool = True) -> list[ModelSpec]:
    """targets x quantiles x parameter sets x (folds + final)."""
    specs = []
    mid = 0
    group = 0
    for t in range(n_targets):
        for q in quantiles:
            for params in params_list:
                folds = list(range(nfold)) if nfold and nfold > 1 else []
                for f in folds + ([-1] if with_final else []):
                    specs.append(ModelSpec(mid, t, float(q), f, group, params, max_rounds))
                    mid += 1
                group += 1
    return specs


__all__ = ["GrowParams", "ModelSpec", "Grower", "make_specs"]
