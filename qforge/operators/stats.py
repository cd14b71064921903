"""Exact quantiles that scale.

Spark's exact ``percentile`` keeps a value->count map for the whole group in
one task, which does not survive a 100 TB column.  ``exact_quantiles``
instead

1. asks ``percentile_approx`` (one distributed pass, bounded sketch) for a
   bracket ``[lo, hi]`` around every requested rank; the sketch's rank error
   is at most N/accuracy, so the true order statistic lies inside;
2. counts rows below each bracket and groups the rows inside the brackets by
   value (a second pass; only ~N/accuracy rows per bracket, fewer distinct
   values when a value repeats a lot);
3. walks the small per-bracket (value, count) lists on the driver to pick
   the exact order statistics and interpolates linearly between them
   (position p*(n-1), as ``quantile_cont`` / ``percentile`` do).

The result is exact, and nothing larger than a bracket ever reaches a
single task or the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

DEFAULT_ACCURACY = 10_000
# a bracket is resolved exactly once it holds at most this many rows;
# larger ones are narrowed by another sketch pass over the bracket only
MAX_BRACKET_ROWS = 100_000
# columns with at most this many values skip the sketch: their values are
# counted and walked directly
DIRECT_MAX_ROWS = 50_000
MAX_REFINE = 6
# the bracket is widened by this many sketch error units on each side
_MARGIN = 3.0


def interpolate(lo: float, hi: float, d: float) -> float:
    return lo + (hi - lo) * d


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float | None]]:
    """One ``percentile_approx`` pass (rank error <= n/accuracy) for callers
    that trade exactness for a single job on very wide or huge data."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(nan_to_null(F.col(c).cast("double")), [float(p) for p in probs],
                                       accuracy).alias(f"a{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: list(row[f"a{i}"]) if row[f"a{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False):
    return approx_quantiles(df, cols, probs) if approx else exact_quantiles(df, cols, probs)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    accuracy: int = DEFAULT_ACCURACY,
                    max_bracket: int = MAX_BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns at once."""
    if not cols:
        return {}
    probs = [float(p) for p in probs]
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"quantile {p} outside [0, 1]")
    data = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"_q{i}")
                       for i, c in enumerate(cols)])
    eps = _MARGIN / accuracy
    lo_p = [max(0.0, p - eps) for p in probs]
    hi_p = [min(1.0, p + eps) for p in probs]
    sketch_p = sorted(set(lo_p + hi_p))
    first = data.agg(*[x for i in range(len(cols)) for x in (
        F.count(f"_q{i}").alias(f"n{i}"), F.min(f"_q{i}").alias(f"mn{i}"),
        F.max(f"_q{i}").alias(f"mx{i}"))]).collect()[0]
    # small columns are resolved exactly at once; larger ones need the
    # sketch to find a bracket
    big = [i for i in range(len(cols)) if (first[f"n{i}"] or 0) > min(max_bracket, DIRECT_MAX_ROWS)]
    sketch = data.agg(*[F.percentile_approx(f"_q{i}", sketch_p, accuracy).alias(f"pa{i}")
                        for i in big]).collect()[0] if big else {}

    brackets: dict[tuple[int, int], tuple[float, float]] = {}
    ranks: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i in range(len(cols)):
        n = first[f"n{i}"]
        if not n:
            continue
        approx = dict(zip(sketch_p, sketch[f"pa{i}"])) if i in big else {}
        for j, p in enumerate(probs):
            lo = first[f"mn{i}"] if (lo_p[j] <= 0.0 or i not in big) else approx[lo_p[j]]
            hi = first[f"mx{i}"] if (hi_p[j] >= 1.0 or i not in big) else approx[hi_p[j]]
            brackets[(i, j)] = (lo, hi)
            pos = p * (n - 1)
            k = math.floor(pos)
            d = pos - k
            ranks[(i, j)] = (k, k + (1 if d > 0 else 0), d)
    if not brackets:
        return {c: [None] * len(probs) for c in cols}

    def inside(key, lo, hi):
        v = F.col(f"_q{key[0]}")
        return (v >= F.lit(lo)) & (v <= F.lit(hi))

    # Every bracket is verified by exact counts before it is used; a refined
    # bracket that misses one of the two ranks falls back to the last
    # verified one (the full [min, max] range is always valid).
    valid: dict[tuple[int, int], tuple[float, float, int]] = {}
    frozen: set = set()
    for key in list(brackets):
        if key[0] not in big:  # full range of a small column: nothing below, all inside
            valid[key] = (brackets[key][0], brackets[key][1], 0)
    pending = {k: v for k, v in brackets.items() if k not in valid}
    for it in range(MAX_REFINE + 1 if pending else 0):
        row = data.agg(*[x for key, (lo, hi) in pending.items() for x in (
            F.count_if(F.col(f"_q{key[0]}") < F.lit(lo)).alias(f"b{key[0]}_{key[1]}"),
            F.count_if(inside(key, lo, hi)).alias(f"c{key[0]}_{key[1]}"))]).collect()[0]
        refine, unchecked = {}, False
        for key, (lo, hi) in list(pending.items()):
            k_lo, k_hi, _ = ranks[key]
            b, cnt = row[f"b{key[0]}_{key[1]}"], row[f"c{key[0]}_{key[1]}"]
            if b <= k_lo and k_hi < b + cnt:
                valid[key] = (lo, hi, b)
                if cnt > max_bracket and key not in frozen and it < MAX_REFINE:
                    p_lo = (k_lo - b) / max(cnt - 1, 1)
                    p_hi = (k_hi - b) / max(cnt - 1, 1)
                    refine[key] = (max(0.0, p_lo - eps), min(1.0, p_hi + eps))
            elif key in valid:
                pending[key] = valid[key][:2]
                frozen.add(key)
            else:
                i = key[0]
                pending[key] = (first[f"mn{i}"], first[f"mx{i}"])
                unchecked = True
        if not refine and not unchecked:
            break
        if refine:
            sk = data.agg(*[F.percentile_approx(F.when(inside(key, *pending[key]), F.col(f"_q{key[0]}")),
                                                list(pp), accuracy).alias(f"s{key[0]}_{key[1]}")
                            for key, pp in refine.items()]).collect()[0]
            for key, (plo, phi) in refine.items():
                vals = sk[f"s{key[0]}_{key[1]}"]
                lo, hi = pending[key]
                pending[key] = (lo if plo <= 0.0 else vals[0], hi if phi >= 1.0 else vals[1])
    brackets = {key: v[:2] for key, v in valid.items()}
    below = {key: v[2] for key, v in valid.items()}

    conds = {key: inside(key, lo, hi) for key, (lo, hi) in brackets.items()}
    cells = F.array(*[F.when(cond, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                            F.col(f"_q{i}").alias("v")))
                      for (i, j), cond in conds.items()])
    any_in = F.lit(False)
    for cond in conds.values():
        any_in = any_in | cond
    counted = (data.filter(any_in)
               .select(F.explode(F.filter(cells, lambda s: s.isNotNull())).alias("s"))
               .groupBy("s.i", "s.j", "s.v").count().collect())
    values: dict[tuple[int, int], list[tuple[float, int]]] = {k: [] for k in brackets}
    for r in counted:
        values[(r["i"], r["j"])].append((r["v"], r["count"]))

    out = {c: [None] * len(probs) for c in cols}
    for (i, j), vals in values.items():
        vals.sort()
        k_lo, k_hi, d = ranks[(i, j)]
        b = below[(i, j)]
        lo_v = _nth(vals, k_lo - b)
        hi_v = lo_v if k_hi == k_lo else _nth(vals, k_hi - b)
        out[cols[i]][j] = interpolate(lo_v, hi_v, d) if d else lo_v
    return out


def _nth(vals: list[tuple[float, int]], idx: int):
    if idx < 0:
        return None
    seen = 0
    for v, cnt in vals:
        seen += cnt
        if idx < seen:
            return v
    return None


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "code",
                      partitions: int | None = None, sample_per_bucket: int = 64) -> DataFrame:
    """0-based position of every row in ``ORDER BY order_cols`` without a
    single-task window.

    Bucket boundaries are picked once on the driver from a bounded sample
    and enter the plan as literals, so a row's bucket is a pure function of
    its values (recomputing a lost partition lands every row in the same
    bucket).  The position is the row's rank inside its bucket plus the
    number of rows in all earlier buckets (one count per bucket).  Ties are
    broken by the full order, so ``order_cols`` should make rows unique.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n_buckets = partitions or spark.sparkContext.defaultParallelism
    key = F.struct(*[F.col(c) for c in order_cols])
    total = df.count()
    bounds = []
    if total > 0 and n_buckets > 1:
        want = n_buckets * sample_per_bucket
        frac = min(1.0, want / total)
        sample = sorted(tuple(r) for r in df.select(*order_cols).sample(fraction=frac, seed=17)
                        .limit(want * 2).collect())
        if sample:
            step = len(sample) / n_buckets
            bounds = sorted({sample[int(step * k)] for k in range(1, n_buckets) if int(step * k) < len(sample)})
    bucket = F.lit(0)
    for b in bounds:
        lit_key = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(b, order_cols)])
        bucket = bucket + (key >= lit_key).cast("int")
    staged = df.withColumn("__bucket", bucket)
    counts = {r["__bucket"]: r["n"] for r in staged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, acc = {}, 0
    for k in sorted(counts):
        offsets[k] = acc
        acc += counts[k]
    offset = (F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])[F.col("__bucket")]
              if offsets else F.lit(0))
    w = Window.partitionBy("__bucket").orderBy(*order_cols)
    return staged.withColumn(out, (F.row_number().over(w) - 1 + offset).cast("int")).drop("__bucket")
