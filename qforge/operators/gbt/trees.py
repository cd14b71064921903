"""Tree pieces that run on small, already aggregated arrays.

* ``Tree``: arrays for one regression tree, grown level by level;
* ``best_splits``: split choice from (G, H, N) histograms with L1/L2
  regularisation, min child weight, missing-value direction and monotone
  constraints (xgboost-style gain, bounds carried to children);
* ``route``: vectorised traversal of a batch of binned rows;
* ``quantile_part``, ``bracket_part``: the part of a leaf's residuals that holds a
  weighted quantile, and the division of such a part into smaller ones;
* ``project_monotone``: makes the refreshed leaf values respect the
  monotone constraints (left <= mid <= right for +1 splits).

The heavy work (rows) never reaches these functions: they see histograms
whose size is models x nodes x features x bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# residual buckets of the first leaf pass: log2(1 + |r| / scale) on an even grid; later passes refine the one that counts
LEAF_PARTS = 4096  # does not change the values, only how many passes find them
RES_OCTAVES = 44  # powers of two covered: |r|/scale up to ~1.7e13
RES_ROWS = 1 << 14  # at a time, so that the steps stay in the cache


def residual_bucket(r: np.ndarray, scale: float, parts: int) -> np.ndarray:
    """Buckets that never decrease with ``r``.

    The bits of a float are its logarithm, straight between powers of two.
    """
    out = np.empty(len(r), np.int64)
    one = np.float32(1).view(np.int32)
    for a in range(0, len(r), RES_ROWS):
        with np.errstate(over="ignore"):
            u = (r[a:a + RES_ROWS] / scale).astype(np.float32)
        bits = (np.abs(u) + np.float32(1)).view(np.int32) - one
        # in doubles: float32 has not enough digits for the sum
        at = np.copysign(bits.astype(np.float64), u)
        at *= parts / (2 * RES_OCTAVES) / (1 << 23)
        at += parts / 2
        np.minimum(np.maximum(at, 0, out=at), parts - 1, out=at)
        out[a:a + RES_ROWS] = at
    return out


@dataclass
class Tree:
    """Arrays indexed by node id; node 0 is the root."""
    feature: list = field(default_factory=lambda: [-1])
    split_bin: list = field(default_factory=lambda: [-1])
    default_left: list = field(default_factory=lambda: [True])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])
    lower: list = field(default_factory=lambda: [-np.inf])
    upper: list = field(default_factory=lambda: [np.inf])

    @property
    def n_nodes(self) -> int:
        return len(self.feature)

    def is_leaf(self, i: int) -> bool:
        return self.left[i] < 0

    def add_children(self, i: int, feature: int, split_bin: int, default_left: bool, gain: float,
                     bounds_left, bounds_right, cover_left: float, cover_right: float) -> None:
        d = self.depth[i] + 1
        ids = []
        for (lo, hi), cov in ((bounds_left, cover_left), (bounds_right, cover_right)):
            ids.append(self.n_nodes)
            self.feature.append(-1)
            self.split_bin.append(-1)
            self.default_left.append(True)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
            self.gain.append(0.0)
            self.cover.append(cov)
            self.depth.append(d)
            self.lower.append(lo)
            self.upper.append(hi)
        self.feature[i], self.split_bin[i], self.default_left[i] = feature, split_bin, default_left
        self.left[i], self.right[i], self.gain[i] = ids[0], ids[1], gain

    def frontier(self, depth: int) -> list[int]:
        return [i for i in range(self.n_nodes) if self.depth[i] == depth and self.is_leaf(i)]

    def leaves(self) -> list[int]:
        return [i for i in range(self.n_nodes) if self.is_leaf(i)]

    def arrays(self) -> dict:
        return {"feature": np.asarray(self.feature, np.int64),
                "split_bin": np.asarray(self.split_bin, np.int64),
                "default_left": np.asarray(self.default_left, bool),
                "left": np.asarray(self.left, np.int64),
                "right": np.asarray(self.right, np.int64),
                "value": np.asarray(self.value, np.float64)}


def route(arr: dict, bins: np.ndarray, max_depth: int) -> np.ndarray:
    """Node reached by every row (stops at the current leaves)."""
    n = bins.shape[0]
    node = np.zeros(n, np.int64)
    rows = np.arange(n)
    for _ in range(max_depth):
        left = arr["left"][node]
        internal = left >= 0
        if not internal.any():
            break
        f = np.where(internal, arr["feature"][node], 0)
        b = bins[rows, f]
        go_left = np.where(b == 0, arr["default_left"][node], b <= arr["split_bin"][node])
        node = np.where(internal, np.where(go_left, left, arr["right"][node]), node)
    return node


def route_values(arr: dict, x: np.ndarray, split_value: np.ndarray, max_depth: int) -> np.ndarray:
    """Same as ``route`` on raw values: left iff x < split_value, NaN by default."""
    n, width = x.shape
    leaf, own = arr["left"] < 0, np.arange(len(arr["left"]))
    # children by (node, goes left); a leaf leads to itself
    child = np.stack([np.where(leaf, own, arr["right"]), np.where(leaf, own, arr["left"])], axis=1).ravel()
    feature = np.where(leaf, 0, arr["feature"])
    values, first = x.ravel(), np.arange(n) * width
    missing = np.isnan(values).any()
    node = np.zeros(n, np.int64)
    for _ in range(max_depth):
        v = values.take(first + feature.take(node))
        with np.errstate(invalid="ignore"):
            go_left = v < split_value.take(node)
        if missing:
            go_left |= np.isnan(v) & arr["default_left"].take(node)
        node = child.take(2 * node + go_left)
    return node


def _thr(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _weight(g, h, lam, alpha, lo, hi):
    w = -_thr(g, alpha) / (h + lam)
    return np.clip(w, lo, hi)


def _gain_given_w(g, h, lam, alpha, w):
    return -(2.0 * g * w + (h + lam) * w * w + 2.0 * alpha * np.abs(w))


@dataclass
class Split:
    node: int
    feature: int
    split_bin: int
    default_left: bool
    gain: float
    weight_left: float
    weight_right: float
    cover_left: float
    cover_right: float


def best_split(G: np.ndarray, H: np.ndarray, allowed: np.ndarray, constraint: np.ndarray,
               lo: float, hi: float, lam: float, alpha: float, min_child_weight: float,
               gamma: float) -> Split | None:
    """Best split of one node from its (features x bins) histograms.

    Bin 0 holds missing values; bins 1..B are ordered.  A split at bin b
    sends bins 1..b left; missing goes left or right, whichever gains more.
    """
    Gt = G[0].sum()
    Ht = H[0].sum()
    w_parent = float(_weight(Gt, Ht, lam, alpha, lo, hi))
    parent_gain = float(_gain_given_w(Gt, Ht, lam, alpha, w_parent))
    best = None
    best_gain = -np.inf
    F_, B1 = G.shape
    if B1 < 3:
        return None
    cg = np.cumsum(G[:, 1:], axis=1)[:, :-1]  # left sums for split bins 1..B-1
    ch = np.cumsum(H[:, 1:], axis=1)[:, :-1]
    gm, hm = G[:, :1], H[:, :1]
    for miss_left in (True, False):
        gl = cg + gm if miss_left else cg
        hl = ch + hm if miss_left else ch
        gr, hr = Gt - gl, Ht - hl
        wl = _weight(gl, hl, lam, alpha, lo, hi)
        wr = _weight(gr, hr, lam, alpha, lo, hi)
        gain = (_gain_given_w(gl, hl, lam, alpha, wl) + _gain_given_w(gr, hr, lam, alpha, wr)
                - parent_gain)
        ok = (hl >= min_child_weight) & (hr >= min_child_weight) & allowed[:, None]
        c = constraint[:, None]
        ok &= ~((c > 0) & (wl > wr)) & ~((c < 0) & (wl < wr))
        gain = np.where(ok, gain, -np.inf)
        k = int(np.argmax(gain))  # first max in (feature, bin) order
        g = gain.flat[k]
        if g > best_gain:  # strict: on a tie the missing-left split wins
            f, b = divmod(k, gain.shape[1])
            best_gain = g
            best = Split(-1, int(f), int(b + 1), miss_left, float(g), float(wl.flat[k]),
                         float(wr.flat[k]), float(hl.flat[k]), float(hr.flat[k]))
    if best is None or not np.isfinite(best_gain) or best_gain <= max(gamma, 1e-6):
        return None
    return best


def child_bounds(split: Split, constraint: int, lo: float, hi: float):
    """xgboost-style bounds: a monotone split cuts the range at the mid weight."""
    if constraint == 0:
        return (lo, hi), (lo, hi)
    mid = 0.5 * (split.weight_left + split.weight_right)
    if constraint > 0:
        return (lo, mid), (mid, hi)
    return (mid, hi), (lo, mid)


def quantile_part(weights: np.ndarray, before: float, target: float) -> tuple[int, float]:
    """First of the ordered parts at which ``before`` and the weights so far reach ``target``, and the weight before it.

    A sum short of the target by rounding alone has reached it.
    """
    cum = before + np.cumsum(weights)
    k = min(int(np.searchsorted(cum, target * (1.0 - 1e-12), side="left")), len(cum) - 1)
    return k, float(cum[k - 1]) if k else before


def bracket_part(r: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray,
                 parts: int) -> np.ndarray:
    """The residual itself where ``whole``, else its part of the range from ``lo`` to ``hi`` in ``parts`` equal ones."""
    part = np.floor((r - lo) / np.where(hi > lo, hi - lo, 1.0) * parts)
    return np.where(whole, r, np.clip(part, 0, parts - 1))


def leaf_part(r: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray, scale: float, parts: int) -> np.ndarray:
    """``bracket_part``, and the bucket of a residual where the range has no ends."""
    out = np.empty(len(r))
    wide = np.isinf(lo) | np.isinf(hi)
    out[wide] = np.where(whole[wide], r[wide], residual_bucket(r[wide], scale, parts))
    out[~wide] = bracket_part(r[~wide], lo[~wide], hi[~wide], whole[~wide], parts)
    return out


def project_monotone(tree: Tree, constraint: np.ndarray) -> None:
    """Clamp leaf values so every monotone split keeps left <= mid <= right.

    Bottom-up: the cover-weighted mean of each subtree; top-down: at a split
    on a +1 (-1) feature the children get bounds cut at the mid point of
    their means (pooled when they are out of order); leaves are clamped to
    the bounds inherited from all ancestors.
    """
    n = tree.n_nodes
    mean = np.zeros(n)
    wsum = np.zeros(n)

    def up(i):
        if tree.is_leaf(i):
            wsum[i] = max(tree.cover[i], 1e-12)
            mean[i] = tree.value[i]
            return
        up(tree.left[i])
        up(tree.right[i])
        l, r = tree.left[i], tree.right[i]
        wsum[i] = wsum[l] + wsum[r]
        mean[i] = (mean[l] * wsum[l] + mean[r] * wsum[r]) / wsum[i]

    def down(i, lo, hi):
        if tree.is_leaf(i):
            tree.value[i] = float(min(max(tree.value[i], lo), hi))
            return
        l, r = tree.left[i], tree.right[i]
        c = int(constraint[tree.feature[i]]) if tree.feature[i] < len(constraint) else 0
        if c == 0:
            down(l, lo, hi)
            down(r, lo, hi)
            return
        ml, mr = mean[l], mean[r]
        if (c > 0 and ml <= mr) or (c < 0 and ml >= mr):
            mid = 0.5 * (ml + mr)
        else:
            mid = mean[i]
        mid = min(max(mid, lo), hi)
        if c > 0:
            down(l, lo, mid)
            down(r, mid, hi)
        else:
            down(l, mid, hi)
            down(r, lo, mid)

    up(0)
    down(0, -np.inf, np.inf)


def splitmix64(x: np.ndarray) -> np.ndarray:
    """Vectorised 64-bit mixer for repeatable per-row sampling decisions."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform01(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = splitmix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
