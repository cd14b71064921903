"""T-2: feature binning for histogram trees.

One aggregation counts distinct values (``approx_count_distinct``).  Features
with at most ``max_bin`` of them get their exact distinct values, the others
the cut points of a ``percentile_approx`` sketch, both in a second, bounded
aggregation.  Rows are then binned by binary search where they are packed
into blocks (``bin_matrix``); bin 0 is reserved for missing values.

A row goes left of split bin ``b`` iff ``x < cuts[b - 1]``, so a tree
grown on bins scores raw values without re-binning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import nan_to_null

# rank error of the cut sketch (1/accuracy) is far below the bin width (1/max_bin)
SKETCH_ACCURACY = 2_000


def compute_cuts(df: DataFrame, features: list[str], max_bin: int = 256, extra_aggs=None):
    """Cut points per feature; with ``extra_aggs`` (Columns) their values are
    computed in the same job and returned as a second result."""
    if not features:
        return ([], df.agg(*extra_aggs).collect()[0]) if extra_aggs else []
    probs = [i / max_bin for i in range(1, max_bin)]
    vals = [nan_to_null(F.col(f).cast("double")) for f in features]
    row = df.agg(*(extra_aggs or []), *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(vals)]).collect()[0]
    low = [i for i, _ in enumerate(features) if (row[f"d{i}"] or 0) <= max_bin]

    def sketches(which: list[int]) -> list:
        return [F.percentile_approx(vals[i], probs, SKETCH_ACCURACY).alias(f"p{i}") for i in which]

    # one task merges the sketches of all partitions: one a core, as merging hundreds of them takes longer than the pass
    merged = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    high = [i for i, _ in enumerate(features) if i not in low]
    # bounded: approx distinct <= max_bin for the columns that are collected
    found = (merged if high else df).agg(*[F.array_sort(F.collect_set(vals[i])).alias(f"s{i}") for i in low],
                                         *sketches(high)).collect()[0].asDict()
    exact = {i: found[f"s{i}"] for i in low}
    more = [i for i in low if len(exact[i]) > max_bin]
    if more:
        found.update(merged.agg(*sketches(more)).collect()[0].asDict())
    cuts = []
    for i, _ in enumerate(features):
        if i in exact and len(exact[i]) <= max_bin:
            v = np.asarray(exact[i], np.float64)
            cuts.append(v[1:])
        else:
            p = found[f"p{i}"] or []
            cuts.append(np.unique(np.asarray([x for x in p if x is not None], np.float64)))
    return (cuts, row) if extra_aggs is not None else cuts


def n_bins(cuts: list[np.ndarray]) -> int:
    """Bins per feature incl. the missing bin: len(cuts) + 2 at most."""
    return max([len(c) + 2 for c in cuts] + [3])


def bin_matrix(values: list[np.ndarray], cuts: list[np.ndarray], dtype) -> np.ndarray:
    """Bins (rows x features) of the values of each feature: 0 = missing (NaN), 1.. = value bins."""
    out = np.zeros((len(values[0]) if values else 0, len(cuts)), dtype)
    for j, (x, c) in enumerate(zip(values, cuts)):
        there = ~np.isnan(x)
        out[there, j] = np.searchsorted(c, x[there], side="right") + 1
    return out
