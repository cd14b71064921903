"""Scalar Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import pandas as pd  # noqa: F401  (pandas_udf annotations)
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Pandas treats NaN as missing, Spark does not; map NaN to NULL."""
    c = col_of(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def try_double(c: str | Column) -> Column:
    return col_of(c).try_cast("double")


def year_range(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """C1: '11+' -> 11, '5-10' -> 7.5, '3' -> 3; numbers pass through.

    Unparsable text gives NULL (the reference raises; count the NULLs with
    ``bad_value_count`` when strict behaviour is wanted).
    """
    c = col_of(c)
    if dtype is not None and isinstance(dtype, T.NumericType):
        return nan_to_null(c.cast("double"))
    s = F.trim(c.cast("string"))
    parts = F.split(s, "-")
    first = F.trim(F.element_at(parts, 1)).try_cast("double")
    second = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    return (F.when(s.contains("+"), F.trim(F.regexp_replace(s, r"\+", "")).try_cast("double"))
            .when(s.contains("-"), (first + second) / F.lit(2.0))
            .otherwise(s.try_cast("double")))


DEFAULT_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
    "MM/dd/yyyy", "dd.MM.yyyy", "MM/dd/yyyy HH:mm", "yyyy-MM",
)


def mixed_date(c: str | Column, formats=DEFAULT_DATE_FORMATS,
               dtype: T.DataType | None = None) -> Column:
    """Per-value date parsing over a list of formats; NULL if none fits."""
    c = col_of(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    s = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Microseconds since 1970-01-01 of a date-time column.

    TIMESTAMP_NTZ values count their wall-clock fields as UTC, so the result
    does not depend on the session time zone; TIMESTAMP values are instants.
    """
    c = col_of(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
    return F.unix_micros(mixed_date(c, dtype=dtype))


def date_epoch_micros(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """C2 + epoch: parse mixed strings, then microseconds since epoch."""
    if isinstance(dtype, T.TimestampNTZType):
        return epoch_micros(c, dtype)
    return F.unix_micros(mixed_date(c, dtype=dtype))


def literal_epoch_micros(value) -> int:
    """Epoch micros of a literal date (naive values are taken as UTC)."""
    import datetime as dt
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return int(round(value.timestamp() * 1_000_000))


def coerce_number(c: str | Column, fill: float = 0.0) -> Column:
    """To double, unparsable or missing -> fill."""
    return F.coalesce(nan_to_null(col_of(c).try_cast("double")), F.lit(float(fill)))


def pinball(y: str | Column, pred: str | Column, q: float | Column,
            weight: str | Column | None = None) -> Column:
    """T-3: w * max(q*(y-p), (q-1)*(y-p))."""
    r = col_of(y) - col_of(pred)
    qq = q if isinstance(q, Column) else F.lit(float(q))
    loss = F.greatest(qq * r, (qq - F.lit(1.0)) * r)
    return loss if weight is None else loss * col_of(weight)


EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """J2 (prefilter / oracle form): great-circle distance in km."""
    la1, lo1, la2, lo2 = (F.radians(col_of(x)) for x in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Below the first price costs are shown in millicents, below the second with four decimals.
MILLICENTS_BELOW, CENTS_FROM = 0.01, 1.0


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable is not copied into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _halves(x: Column) -> tuple[Column, Column]:
    """``x`` as the sum of two doubles of 26 bits each."""
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    return high, x - high


def fixed_decimals(value: Column, places: int) -> Column:
    """``value`` with ``places`` decimals, rounded by its exact binary value (a tie to the even digit).

    ``format_string`` rounds the shortest decimal form instead (2.335 gives
    2.34, although the double lies below 2.335).  Here the product with the
    power of ten is held as a double and its rounding error, both exact.
    """
    scale = F.lit(float(10 ** places))

    def digits(size: Column, near: Column) -> Column:
        (a, b), (c, d) = _halves(size), _halves(scale)
        error = ((a * c - near) + a * d + b * c) + b * d
        over = (near - F.floor(near) - 0.5) + error
        return F.floor(near) + F.when((over > 0) | ((over == 0) & (F.floor(near) % 2 == 1)), 1).otherwise(0)

    def text(n: Column) -> Column:
        whole, rest = (n / 10 ** places).cast("long"), F.pmod(n, F.lit(10 ** places))
        return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), places, "0"))

    shown = bound(F.abs(value), lambda size: bound(size * scale, lambda near: bound(digits(size, near), text)))
    return F.concat(F.when(value < 0, "-").otherwise(""), shown)


def format_cost(c: str | Column) -> Column:
    """M6: a price in dollars as text: millicents, four or two decimals by its size."""
    dollars = col_of(c).cast("double")
    return (F.when(dollars < MILLICENTS_BELOW, F.concat(F.lit("$"), fixed_decimals(dollars * 1000, 2), F.lit(" (millicents)")))
            .when(dollars < CENTS_FROM, F.concat(F.lit("$"), fixed_decimals(dollars, 4)))
            .otherwise(F.concat(F.lit("$"), fixed_decimals(dollars, 2))))


def estimate_tokens(text: str | Column) -> Column:
    """M7: integer length/4 fallback token estimate."""
    return F.floor(F.length(col_of(text)) / 4).cast("long")


TRUNCATION_MARKER = "... [truncated]"


def truncate_text(c: str | Column, max_len: int = 500) -> Column:
    """H5: keep the first max_len characters and mark the cut."""
    c = col_of(c)
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len), F.lit(TRUNCATION_MARKER))).otherwise(c)


def model_label(q: str | Column) -> Column:
    """T-10: 'p' + int(q*100), truncating like the reference (0.29 -> p28)."""
    return F.concat(F.lit("p"), F.floor(col_of(q) * 100).cast("int").cast("string"))
