"""Cleaning, projection and outlier filtering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerce_number, mixed_date, year_range
from .stats import quantiles

YEAR_RANGE_COLUMNS = ("YearsOfExperience", "YearsAtCompany")
DATE_COLUMN = "Date"


def _dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def clean(df: DataFrame, targets: list[str] | None = None,
          year_cols: tuple[str, ...] = YEAR_RANGE_COLUMNS,
          date_col: str | None = DATE_COLUMN) -> DataFrame:
    """C4 = C1 + C2 + C3 in one projection; absent columns are skipped."""
    types = _dtypes(df)
    repl: dict[str, Column] = {}
    for c in year_cols:
        if c in types:
            repl[c] = year_range(F.col(c), types[c])
    if date_col and date_col in types:
        repl[date_col] = mixed_date(F.col(date_col), dtype=types[date_col])
    for c in targets or []:
        if c in types:
            repl[c] = coerce_number(F.col(c))
    return df.withColumns(repl) if repl else df


def bad_value_count(df: DataFrame, col: str) -> DataFrame:
    """How many non-empty values C1 could not parse (strict mode input)."""
    types = _dtypes(df)
    return df.agg(F.count_if(F.col(col).isNotNull() & year_range(F.col(col), types[col]).isNull())
                  .alias("bad_values"))


@dataclass
class Bounds:
    column: str
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None


def iqr_bounds(df: DataFrame, targets: list[str], threshold: float = 1.5,
               approx: bool = False) -> list[Bounds]:
    """Q1/Q3 by linear interpolation on the unfiltered frame, all targets
    in one pass; bounds Q1 - t*IQR and Q3 + t*IQR (``approx`` = one sketch
    pass instead of the exact bracket refinement)."""
    present = [t for t in targets if t in df.columns]
    qs = quantiles(df, present, [0.25, 0.75], approx)
    out = []
    for t in present:
        q1, q3 = qs[t]
        if q1 is None:
            out.append(Bounds(t, None, None, None, None))
            continue
        iqr = q3 - q1
        out.append(Bounds(t, q1, q3, q1 - threshold * iqr, q3 + threshold * iqr))
    return out


def bounds_frame(spark, bounds: list[Bounds]) -> DataFrame:
    schema = "target string, q1 double, q3 double, lower double, upper double"
    return spark.createDataFrame([(b.column, b.q1, b.q3, b.lower, b.upper) for b in bounds], schema)


def inside_bounds(bounds: list[Bounds], types: dict | None = None, null_as_false: bool = True) -> Column:
    """Row predicate: every target inside its inclusive bounds.

    A NULL or NaN target fails (NaN compares above every number).  On
    DOUBLE columns the predicate is plain comparisons of the column with
    literals, which Parquet can take as a pushed filter; ``null_as_false``
    wraps it for counting (a filter drops NULL anyway).
    """
    cond = F.lit(True)
    for b in bounds:
        if b.lower is None:  # all-NULL target: every row fails, like NaN compares
            cond = cond & F.lit(False)
            continue
        dt = (types or {}).get(b.column)
        v = F.col(b.column) if isinstance(dt, T.DoubleType) else F.col(b.column).cast("double")
        cond = cond & (v >= F.lit(float(b.lower))) & (v <= F.lit(float(b.upper)))
    return F.coalesce(cond, F.lit(False)) if null_as_false else cond


def remove_outliers(df: DataFrame, targets: list[str], method: str = "iqr",
                    threshold: float = 1.5, with_counts: bool = False, approx: bool = False):
    """Keep rows whose every present target lies inside its bounds.

    The bounds are a handful of scalars, so they go into the plan as
    literals: the filter is pushed into the scan and needs no join.
    Returns ``(frame, removed)``; ``removed`` is computed (one job counting
    both sides) only when ``with_counts``.
    """
    if method != "iqr":
        raise NotImplementedError(f"Outlier removal method '{method}' is not implemented")
    bounds = iqr_bounds(df, targets, threshold, approx)
    if not bounds:
        return (df, 0) if with_counts else (df, None)
    types = _dtypes(df)
    kept = df.filter(inside_bounds(bounds, types, null_as_false=False))
    if not with_counts:
        return kept, None
    keep = inside_bounds(bounds, types)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("k")).collect()[0]
    return kept, int(row["n"] - row["k"])


def prepare_training(df: DataFrame, targets: list[str], drop_outliers: bool = False,
                     threshold: float = 1.5, date_col: str | None = DATE_COLUMN):
    """C4 then optional C6; returns (frame, removed count or 0)."""
    cleaned = clean(df, targets, date_col=date_col)
    if not drop_outliers:
        return cleaned, 0
    return remove_outliers(cleaned, targets, threshold=threshold, with_counts=True)


def select_features(df: DataFrame, names: list[str], extra: list[str] | None = None) -> DataFrame:
    """Configured features in order, then extras not already listed."""
    ordered = list(names) + [e for e in (extra or []) if e not in names]
    missing = [n for n in ordered if n not in df.columns]
    if missing:
        raise ValueError(f"Features not found in data: {missing}")
    return df.select(*ordered)


def select_numeric(df: DataFrame) -> list[str]:
    """Numeric columns (booleans are not numeric, as in NumPy)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_categorical(df: DataFrame) -> list[str]:
    """String columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


@dataclass
class ColumnMatch:
    matched: list[str]
    not_found: list[str]
    not_numeric: list[str]


def resolve_columns(df: DataFrame, requested: str | list[str] | None) -> ColumnMatch:
    """C11: comma-separated names, trimmed, matched case-insensitively."""
    if requested is None:
        return ColumnMatch(select_numeric(df), [], [])
    items = requested.split(",") if isinstance(requested, str) else list(requested)
    items = [i.strip() for i in items if i and i.strip()]
    by_lower = {c.strip().lower(): c for c in df.columns}
    numeric = set(select_numeric(df))
    matched, not_found, not_numeric = [], [], []
    for item in items:
        col = by_lower.get(item.lower())
        if col is None:
            not_found.append(item)
        elif col not in numeric:
            not_numeric.append(col)
        elif col not in matched:
            matched.append(col)
    return ColumnMatch(matched, not_found, not_numeric)


def target_overview(df: DataFrame, targets: list[str]) -> list[str]:
    """The configured targets that exist in the frame (for A10/A11)."""
    return [t for t in targets if t in df.columns]


def missing_values(required: DataFrame, provided: DataFrame, key: str) -> DataFrame:
    """Required - provided as a left-anti join (e.g. levels not in a mapping)."""
    return required.join(provided, key, "left_anti")


def drop_nulls_in(df: DataFrame, col: str) -> DataFrame:
    """C12."""
    return df.filter(F.col(col).isNotNull())


def filter_equals(df: DataFrame, **equalities) -> DataFrame:
    """Conjunctive equality predicates (status='FINISHED', ...)."""
    cond = F.lit(True)
    for k, v in equalities.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)
