"""Profiling aggregations.

Every profile is one aggregation over all requested columns (Catalyst
plans a single partial + final HashAggregate), plus the two small passes of
``exact_quantiles`` when quartiles are wanted.  Per-value counts use
``groupBy`` whose map-side partial aggregation collapses hot values before
the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from .clean import resolve_columns, select_categorical, select_numeric
from .stats import quantiles

# countDistinct over many columns expands every row once per column;
# batch the columns so one job never expands more than this many times.
DISTINCT_BATCH = 16


# Column type names as the reference reports them (pandas dtype names).
PANDAS_DTYPES = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32",
                 "smallint": "int16", "tinyint": "int8", "boolean": "bool", "string": "object",
                 "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}


def pandas_dtype(dt: T.DataType) -> str:
    return PANDAS_DTYPES.get(dt.simpleString(), dt.simpleString())


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def _value(c: str, dt: T.DataType) -> Column:
    col = F.col(c)
    return nan_to_null(col) if isinstance(dt, (T.DoubleType, T.FloatType)) else col


def _round(x, nd):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(round(float(x), nd))


def _batched(seq, n):
    for i in range(0, len(seq), n):
        yield seq[i:i + n]


def _distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null counts; exact ``countDistinct`` in batches of 16
    columns (bounded Expand), or one HyperLogLog pass with ``approx``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, int] = {}
    agg = F.approx_count_distinct if approx else F.countDistinct
    for batch in ([cols] if approx else _batched(cols, DISTINCT_BATCH)):
        if not batch:
            continue
        row = df.agg(*[agg(_value(c, types[c])).alias(f"d{i}")
                       for i, c in enumerate(batch)]).collect()[0]
        out.update({c: int(row[f"d{i}"]) for i, c in enumerate(batch)})
    return out


def data_summary(df: DataFrame) -> dict:
    """A1: total_samples, shape, unique_<name> for every string column."""
    if df is None or len(df.columns) == 0:
        return {}
    cats = select_categorical(df)
    n = df.count()
    if n == 0:
        return {}
    summary = {"total_samples": n, "shape": (n, len(df.columns))}
    for c, d in _distinct_counts(df, cats).items():
        summary[f"unique_{c.lower().replace(' ', '_')}"] = d
    return summary


def data_summary_frame(df: DataFrame) -> DataFrame:
    """A1 as a lazy one-row frame (one aggregation)."""
    cats = select_categorical(df)
    return df.agg(F.count(F.lit(1)).alias("total_samples"),
                  F.lit(len(df.columns)).cast("long").alias("n_columns"),
                  *[F.countDistinct(F.col(c)).alias(f"unique_{c.lower().replace(' ', '_')}")
                    for c in cats])


def column_statistics(df: DataFrame, cols: list[str] | None = None,
                      with_quantiles: bool = True, approx: bool = False) -> DataFrame:
    """A2 + A3 for many columns in one pass.

    Returns one row per column: column, dtype, total_count, null_count,
    null_percentage (2 dp), unique_count, and for numeric (non-boolean)
    columns mean, std (sample), min, max, q25, median, q75 (4 dp).
    ``approx=True`` swaps exact distinct counts and quartiles for
    HyperLogLog and one quantile sketch (single passes for huge tables).
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = cols or df.columns
    numeric = [c for c in cols if _is_numeric(types[c])]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = _value(c, types[c])
        aggs.append(F.count_if(v.isNull()).alias(f"null{i}"))
        if c in numeric:
            aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                     F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    row = df.agg(*aggs).collect()[0]
    distinct = _distinct_counts(df, cols, approx)
    quart = quantiles(df, numeric, [0.25, 0.5, 0.75], approx) if (numeric and with_quantiles) else {}
    n = row["_n"]
    out = []
    for i, c in enumerate(cols):
        nulls = row[f"null{i}"]
        rec = [c, pandas_dtype(types[c]), n, nulls,
               _round(nulls / n * 100, 2) if n else None, distinct[c]]
        if c in numeric:
            q = quart.get(c, [None] * 3)
            std = row[f"std{i}"]
            rec += [_round(row[f"mean{i}"], 4), _round(std, 4), _round(row[f"min{i}"], 4),
                    _round(row[f"max{i}"], 4), _round(q[1], 4), _round(q[0], 4), _round(q[2], 4)]
        else:
            rec += [None] * 7
        out.append(tuple(rec))
    schema = ("column string, dtype string, total_count long, null_count long, "
              "null_percentage double, unique_count long, mean double, std double, "
              "min double, max double, median double, q25 double, q75 double")
    return spark.createDataFrame(out, schema)


def boolean_stats(df: DataFrame, col: str) -> DataFrame:
    """A4: true / false / null counts."""
    c = F.col(col)
    return df.agg(F.count_if(c).alias("true_count"), F.count_if(~c).alias("false_count"),
                  F.count_if(c.isNull()).alias("null_count"))


def sample_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """A5: first n non-null values as strings (booleans as 1/0); ties broken
    by value (T14)."""
    v = F.col("v")
    text = v.cast("int").cast("string") if isinstance(df.schema[col].dataType, T.BooleanType) else v.cast("string")
    return (df.select(F.col(col).alias("v")).filter(v.isNotNull())
            .orderBy("v").limit(n).select(text.alias("value")))


def value_counts(df: DataFrame, col: str, limit: int | None = 20) -> DataFrame:
    """Counts per non-null value, most frequent first (ties by value).

    percentage = count / all rows (NULLs included) * 100; also carries
    total_unique_values and showing_top.  ``limit=None`` keeps every value
    (A7 level counts).  The scalars come from one small aggregate; the
    counts from a partial+final aggregation, then TakeOrderedAndProject.
    """
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col(col)).alias("u")).collect()[0]
    n, u = int(totals["n"]), int(totals["u"])
    counts = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).count())
    shown = u if limit is None else min(limit, u)
    ordered = counts.orderBy(F.desc("count"), F.asc("value"))
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(
        F.col("value").cast("string").alias("value"), F.col("count"),
        (F.col("count") * F.lit(100.0) / F.lit(float(n) if n else float("nan"))).alias("percentage"),
        F.lit(u).cast("long").alias("total_unique_values"),
        F.lit(shown).cast("long").alias("showing_top"))


def level_counts(df: DataFrame, col: str) -> DataFrame:
    """Plain value counts with no limit."""
    return value_counts(df, col, limit=None)


def top_locations(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent locations."""
    return value_counts(df, col, limit=k)


class CorrelationError(ValueError):
    def __init__(self, detail: dict):
        super().__init__(detail["error"])
        self.detail = detail


def _pair_corr(a: Column, b: Column) -> Column:
    """Pearson on pairwise-complete rows; NULL (not an error) on constants."""
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(am, bm), F.stddev_samp(am) * F.stddev_samp(bm))


def _corr_columns(df: DataFrame, cols) -> list[str]:
    numeric = select_numeric(df)
    if cols is None:
        col_list = numeric
        match = None
    else:
        match = resolve_columns(df, cols)
        col_list = match.matched
    if len(col_list) < 2:
        detail = {"error": "Need at least 2 numeric columns for correlation",
                  "requested_columns": cols, "available_columns": list(df.columns),
                  "numeric_columns": numeric, "matched_columns": col_list}
        if match is not None:
            detail["not_found"] = match.not_found
            detail["not_numeric"] = match.not_numeric
        raise CorrelationError(detail)
    return col_list


# above this many columns the pair aggregates are built as moment matrices
WIDE_CORRELATION = 40


def correlation_pairs(df: DataFrame, cols=None, full: bool = False, method: str = "auto") -> DataFrame:
    """Pearson correlations of all column pairs, pairwise-complete.

    Output is long: (column_1, column_2, correlation); the upper triangle in
    column order, or with ``full`` every ordered pair incl. the diagonal.
    Up to ``WIDE_CORRELATION`` columns it is ONE aggregation of
    covar/stddev per pair; wider tables use ``correlation_moments`` (one
    c x c moment matrix per task, summed by a shuffle of c^2 cells).
    """
    col_list = _corr_columns(df, cols)
    if method == "moments" or (method == "auto" and len(col_list) > WIDE_CORRELATION):
        return correlation_moments(df, col_list, full)
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = {c: _value(c, types[c]).cast("double") for c in col_list}
    pairs = [(a, b) for i, a in enumerate(col_list) for b in col_list[i + 1:]]
    if full:
        pairs = [(a, b) for a in col_list for b in col_list]
    aggs = [_pair_corr(vals[a], vals[b]).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"),
                 F.col(f"c{k}").alias("correlation"))
        for k, (a, b) in enumerate(pairs)]))
    return wide.select(stacked.alias("p")).select("p.*")


_MOMENTS_SCHEMA = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def correlation_moments(df: DataFrame, col_list: list[str], full: bool = False) -> DataFrame:
    """Pairwise-complete Pearson for wide tables.

    Each task turns its rows into a value matrix X (NULL/NaN -> 0) and a
    mask M, and accumulates, for every column pair, the count M'M, the sums
    (X'M, M'X), the squares and the cross products X'X over the rows where
    both values exist; one ``groupBy(i, j).sum`` adds the tasks' matrices.
    The driver only sees c^2 rows.  Sums are taken around a per-column
    shift (the column mean) to keep the cancellation error small.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    c = len(col_list)
    vals = df.select(*[nan_to_null(F.col(x).cast("double")).alias(f"_c{k}") for k, x in enumerate(col_list)])
    means = vals.agg(*[F.avg(f"_c{k}").alias(f"m{k}") for k in range(c)]).collect()[0]
    shift = np.array([means[f"m{k}"] or 0.0 for k in range(c)])

    def fn(it):
        acc = None
        for b in it:
            if b.num_rows == 0:
                continue
            X = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(c)], axis=1)
            M = ~np.isnan(X)
            X = np.where(M, X - shift, 0.0)
            Mf = M.astype(np.float64)
            part = (Mf.T @ Mf, X.T @ Mf, Mf.T @ X, (X * X).T @ Mf, Mf.T @ (X * X), X.T @ X)
            acc = part if acc is None else tuple(a + p for a, p in zip(acc, part))
        if acc is not None:
            ii, jj = np.meshgrid(np.arange(c), np.arange(c), indexing="ij")
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(ii.ravel().astype(np.int32)), "j": pa.array(jj.ravel().astype(np.int32)),
                "n": acc[0].ravel(), "sx": acc[1].ravel(), "sy": acc[2].ravel(), "sxx": acc[3].ravel(),
                "syy": acc[4].ravel(), "sxy": acc[5].ravel()})

    sums = (vals.mapInArrow(fn, _MOMENTS_SCHEMA).groupBy("i", "j")
            .agg(*[F.sum(x).alias(x) for x in ["n", "sx", "sy", "sxx", "syy", "sxy"]]))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    corr = F.when(n > 1, F.try_divide(cov, F.sqrt(vx * vy)))
    keep = (F.col("i") < F.col("j")) if not full else F.lit(True)
    names = F.array(*[F.lit(x) for x in col_list])
    return (sums.filter(keep)
            .select(F.element_at(names, F.col("i") + 1).alias("column_1"),
                    F.element_at(names, F.col("j") + 1).alias("column_2"),
                    F.when((vx > 0) & (vy > 0), corr).alias("correlation")))


def describe(df: DataFrame, col: str) -> DataFrame:
    """A10: count, mean, std, min, 25%, 50%, 75%, max with exact quartiles."""
    st = column_statistics(df, [col]).collect()[0]
    v = _value(col, df.schema[col].dataType)
    cnt = df.agg(F.count(v)).collect()[0][0]
    rows = [("count", float(cnt)), ("mean", st["mean"]), ("std", st["std"]), ("min", st["min"]),
            ("25%", st["q25"]), ("50%", st["median"]), ("75%", st["q75"]), ("max", st["max"])]
    return df.sparkSession.createDataFrame(rows, "statistic string, value double")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max; empty bins kept.

    bin = least(floor((x-min)/(max-min)*bins), bins-1); the max falls in the
    last bin.  Counting is a partial+final aggregate over at most ``bins``
    keys; the empty bins come from a left join with ``range(bins)``.
    """
    spark = df.sparkSession
    v = nan_to_null(F.col(col).cast("double"))
    mm = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).collect()[0]
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").count()
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def kde(df: DataFrame, col: str, grid_size: int = 200, bins: int = 4096,
        cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) over an even grid.

    Rows are pre-aggregated into ``bins`` fine equal-width bins (partial
    aggregation, bounded output), then every grid point sums
    n_b * exp(-0.5*((g - centre_b)/h)^2) over the bins.  The grid spans
    [min - cut*h, max + cut*h] as the plotting default does.
    """
    spark = df.sparkSession
    v = nan_to_null(F.col(col).cast("double"))
    st = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"),
                F.max(v).alias("hi")).collect()[0]
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "point int, x double, density double")
    h = sd * n ** (-0.2)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    binned = (df.select(b.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("nb"))
              .select((F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(width)).alias("c"), "nb"))
    g0, g1 = lo - cut * h, hi + cut * h
    step = (g1 - g0) / (grid_size - 1)
    contrib = (binned.select("c", "nb", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("point"))
               .withColumn("x", F.lit(g0) + F.col("point") * F.lit(step))
               .groupBy("point", "x")
               .agg(F.sum(F.col("nb") * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col("c")) / F.lit(h), 2)))
                    .alias("mass")))
    return contrib.select("point", "x", (F.col("mass") / F.lit(n * h * math.sqrt(2 * math.pi)))
                          .alias("density"))


def distinct_ratio(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct non-null / all rows (0 when empty), per column."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    n = F.count(F.lit(1))
    wide = df.agg(*[F.coalesce(F.try_divide(F.countDistinct(_value(c, types[c])), n), F.lit(0.0))
                    .alias(f"r{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"r{i}").cast("double").alias("unique_ratio"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def null_share(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Share of missing values per column and the >50 % ignore flag."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    n = F.count(F.lit(1))
    wide = df.agg(*[F.coalesce(F.try_divide(F.count_if(_value(c, types[c]).isNull()), n), F.lit(0.0))
                    .alias(f"s{i}") for i, c in enumerate(cols)])
    return (wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").cast("double").alias("null_share"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
        .withColumn("ignore", F.col("null_share") > F.lit(threshold)))


def profile(df: DataFrame) -> DataFrame:
    """All-column profile: A2/A3 statistics plus A14 ratios, one row each."""
    stats = column_statistics(df)
    return stats.withColumn(
        "unique_ratio", F.when(F.col("total_count") > 0,
                               F.col("unique_count") / F.col("total_count")).otherwise(F.lit(0.0)))

