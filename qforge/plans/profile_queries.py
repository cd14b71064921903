"""Registered cleaning and profiling queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import coerce_number, year_range
from ..operators import clean as C
from ..operators import profile as P
from .registry import load, query

# -- C1: year ranges written like the reference's experience columns -------
# '11+' for sizes divisible by 3, '5-10' style ranges for remainder 1,
# plain numbers otherwise, derived from every part row.
def _years_text():
    size = F.col("p_size")
    return (F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit("+")))
            .when(size % 3 == 1, F.concat(size.cast("string"), F.lit("-"), (size + 5).cast("string")))
            .otherwise(size.cast("string")))


@query("clean_year_range", oracle="""
WITH t AS (
  SELECT p_partkey,
         CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) || '+'
              WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 5 AS VARCHAR)
              ELSE CAST(p_size AS VARCHAR) END AS years
  FROM part)
SELECT p_partkey, years,
       CASE WHEN contains(years, '+') THEN TRY_CAST(trim(replace(years, '+', '')) AS DOUBLE)
            WHEN contains(years, '-') THEN (TRY_CAST(trim(split_part(years, '-', 1)) AS DOUBLE)
                                           + TRY_CAST(trim(split_part(years, '-', 2)) AS DOUBLE)) / 2.0
            ELSE TRY_CAST(trim(years) AS DOUBLE) END AS years_value
FROM t
""")
def clean_year_range(spark, sf):
    part = load(spark, sf, "part")
    t = part.select("p_partkey", _years_text().alias("years"))
    return t.select("p_partkey", "years", year_range(F.col("years")).alias("years_value"))


@query("clean_numeric_props", oracle="""
SELECT event_id,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k_value,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS event_type_value
FROM events
""")
def clean_numeric_props(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id",
                     coerce_number(F.get_json_object("props", "$.k")).alias("k_value"),
                     coerce_number(F.col("event_type")).alias("event_type_value"))


_IQR_SQL = """
WITH q AS (
  SELECT 'l_extendedprice' AS target, quantile_cont(l_extendedprice, 0.25) AS q1,
         quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem
  UNION ALL
  SELECT 'l_quantity', quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.75) FROM lineitem)
SELECT target, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q
"""
_TARGETS = ["l_extendedprice", "l_quantity"]


@query("iqr_bounds", oracle=_IQR_SQL)
def iqr_bounds(spark, sf):
    li = load(spark, sf, "lineitem")
    return C.bounds_frame(spark, C.iqr_bounds(li, _TARGETS, 1.5))


@query("remove_outliers", oracle=f"""
WITH b AS ({_IQR_SQL}),
 p AS (SELECT lower AS lo, upper AS hi FROM b WHERE target = 'l_extendedprice'),
 q AS (SELECT lower AS lo, upper AS hi FROM b WHERE target = 'l_quantity')
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity
FROM lineitem, p, q
WHERE l_extendedprice BETWEEN p.lo AND p.hi AND l_quantity BETWEEN q.lo AND q.hi
""")
def remove_outliers(spark, sf):
    li = load(spark, sf, "lineitem")
    kept, _ = C.remove_outliers(li, _TARGETS, "iqr", 1.5)
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query("outlier_counts", oracle=f"""
WITH b AS ({_IQR_SQL}),
 p AS (SELECT lower AS lo, upper AS hi FROM b WHERE target = 'l_extendedprice'),
 q AS (SELECT lower AS lo, upper AS hi FROM b WHERE target = 'l_quantity')
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE l_extendedprice BETWEEN p.lo AND p.hi AND l_quantity BETWEEN q.lo AND q.hi) AS kept_rows,
       count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN p.lo AND p.hi AND l_quantity BETWEEN q.lo AND q.hi)) AS removed_rows
FROM lineitem, p, q
""")
def outlier_counts(spark, sf):
    li = load(spark, sf, "lineitem")
    keep = C.inside_bounds(C.iqr_bounds(li, _TARGETS, 1.5), dict((f.name, f.dataType) for f in li.schema.fields))
    return li.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(keep).alias("kept_rows"),
                  F.count_if(~keep).alias("removed_rows"))


@query("data_summary", oracle="""
SELECT count(*) AS total_samples, CAST(6 AS BIGINT) AS n_columns,
       count(DISTINCT o_orderstatus) AS unique_o_orderstatus,
       count(DISTINCT o_orderpriority) AS unique_o_orderpriority
FROM orders
""")
def data_summary(spark, sf):
    return P.data_summary_frame(load(spark, sf, "orders"))


def _stats_sql(table: str, col: str, numeric: bool) -> str:
    base = (f"SELECT '{col}' AS \"column\", count(*) AS total_count, "
            f"count(*) FILTER (WHERE {col} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {col} IS NULL) / count(*) * 100, 2) AS null_percentage, "
            f"count(DISTINCT {col}) AS unique_count, ")
    if numeric:
        base += (f"round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS std, "
                 f"round(min({col}), 4) AS min, round(max({col}), 4) AS max, "
                 f"round(quantile_cont({col}, 0.5), 4) AS median, "
                 f"round(quantile_cont({col}, 0.25), 4) AS q25, "
                 f"round(quantile_cont({col}, 0.75), 4) AS q75 ")
    else:
        base += ("CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                 "CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median, "
                 "CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q75 ")
    return base + f"FROM {table}"


_STAT_COLS = [("o_totalprice", True), ("o_custkey", True), ("o_orderstatus", False),
              ("o_orderpriority", False)]


@query("column_statistics", oracle="\nUNION ALL\n".join(
    _stats_sql("orders", c, n) for c, n in _STAT_COLS))
def column_statistics(spark, sf):
    orders = load(spark, sf, "orders")
    return P.column_statistics(orders, [c for c, _ in _STAT_COLS]).drop("dtype")


@query("value_counts", oracle="""
WITH c AS (SELECT o_orderpriority AS value, count(*) AS count FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1),
     t AS (SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS u FROM orders)
SELECT CAST(value AS VARCHAR) AS value, count,
       CAST(count AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n AS DOUBLE) AS percentage,
       u AS total_unique_values, least(CAST(20 AS BIGINT), u) AS showing_top
FROM c, t ORDER BY count DESC, value LIMIT 20
""")
def value_counts(spark, sf):
    return P.value_counts(load(spark, sf, "orders"), "o_orderpriority", 20)


@query("top_values_part_type", oracle="""
WITH c AS (SELECT p_type AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY 1),
     t AS (SELECT count(*) AS n, count(DISTINCT p_type) AS u FROM part)
SELECT CAST(value AS VARCHAR) AS value, count,
       CAST(count AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n AS DOUBLE) AS percentage,
       u AS total_unique_values, least(CAST(3 AS BIGINT), u) AS showing_top
FROM c, t ORDER BY count DESC, value LIMIT 3
""")
def top_values_part_type(spark, sf):
    return P.top_locations(load(spark, sf, "part"), "p_type", 3)


@query("level_counts", oracle="""
WITH c AS (SELECT c_mktsegment AS value, count(*) AS count FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1),
     t AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS u FROM customer)
SELECT CAST(value AS VARCHAR) AS value, count,
       CAST(count AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n AS DOUBLE) AS percentage,
       u AS total_unique_values, u AS showing_top
FROM c, t
""")
def level_counts(spark, sf):
    return P.level_counts(load(spark, sf, "customer"), "c_mktsegment")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_pairs", oracle="\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def correlation_pairs(spark, sf):
    out = P.correlation_pairs(load(spark, sf, "lineitem"), _CORR_COLS)
    return out.withColumn("correlation", F.round("correlation", 4))


@query("correlation_matrix", oracle="\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 4) AS correlation FROM orders"
    for a in ["o_totalprice", "o_custkey"] for b in ["o_totalprice", "o_custkey"]))
def correlation_matrix(spark, sf):
    out = P.correlation_pairs(load(spark, sf, "orders"), "o_totalprice, O_CUSTKEY , missing_col",
                              full=True)
    return out.withColumn("correlation", F.round("correlation", 4))


@query("histogram", oracle="""
WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin
       FROM orders, mm WHERE o_totalprice IS NOT NULL),
 g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT g.bin, lo + g.bin * ((hi - lo) / 20) AS lower, lo + (g.bin + 1) * ((hi - lo) / 20) AS upper,
       count(b.bin) AS count
FROM g CROSS JOIN mm LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin, lo, hi
""")
def histogram(spark, sf):
    return P.histogram(load(spark, sf, "orders"), "o_totalprice", 20)


@query("kde", oracle="""
WITH st AS (SELECT count(o_totalprice) AS n, stddev_samp(o_totalprice) AS sd,
                   min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
 p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS h, (hi - lo) / 256 AS w FROM st),
 b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 255) AS INTEGER) AS bin, count(*) AS nb
       FROM orders, p WHERE o_totalprice IS NOT NULL GROUP BY 1),
 c AS (SELECT lo + (bin + 0.5) * w AS c, nb FROM b, p),
 g AS (SELECT CAST(range AS INTEGER) AS point,
              (lo - 3.0 * h) + range * (((hi + 3.0 * h) - (lo - 3.0 * h)) / 49) AS x FROM p, range(50))
SELECT point, round(x, 4) AS x,
       round(sum(nb * exp(-0.5 * pow((x - c) / h, 2))) / (n * h * sqrt(2 * pi())) * 1e6, 9) AS density_ppm
FROM g, c, p GROUP BY point, x, n, h
""")
def kde(spark, sf):
    out = P.kde(load(spark, sf, "orders"), "o_totalprice", grid_size=50, bins=256)
    return out.select("point", F.round("x", 4).alias("x"),
                      F.round(F.col("density") * 1e6, 9).alias("density_ppm"))


@query("distinct_ratio", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS unique_ratio FROM customer"
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def distinct_ratio(spark, sf):
    return P.distinct_ratio(load(spark, sf, "customer"))


@query("null_share", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_share, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) > 0.5 AS \"ignore\" FROM labels"
    for c in ["doc_id", "quality", "toxic"]))
def null_share(spark, sf):
    return P.null_share(load(spark, sf, "labels"))


_BOOL_SQL = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END"


@query("boolean_stats", oracle=f"""
SELECT count(*) FILTER (WHERE {_BOOL_SQL}) AS true_count,
       count(*) FILTER (WHERE NOT ({_BOOL_SQL})) AS false_count,
       count(*) FILTER (WHERE ({_BOOL_SQL}) IS NULL) AS null_count
FROM orders
""")
def boolean_stats(spark, sf):
    o = load(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean")).otherwise(
        F.col("o_orderstatus") == "F")
    return P.boolean_stats(o.select(flag.alias("is_final")), "is_final")


@query("sample_values", oracle="""
SELECT CAST(c_name AS VARCHAR) AS value FROM customer WHERE c_name IS NOT NULL ORDER BY c_name LIMIT 5
""")
def sample_values(spark, sf):
    return P.sample_values(load(spark, sf, "customer"), "c_name", 5)


@query("describe", oracle="""
WITH s AS (SELECT count(o_totalprice) AS cnt, round(avg(o_totalprice), 4) AS mean,
                  round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS mn,
                  round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
                  round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
                  round(quantile_cont(o_totalprice, 0.75), 4) AS p75,
                  round(max(o_totalprice), 4) AS mx FROM orders)
SELECT 'count' AS statistic, CAST(cnt AS DOUBLE) AS value FROM s
UNION ALL SELECT 'mean', mean FROM s UNION ALL SELECT 'std', std FROM s
UNION ALL SELECT 'min', mn FROM s UNION ALL SELECT '25%', p25 FROM s
UNION ALL SELECT '50%', p50 FROM s UNION ALL SELECT '75%', p75 FROM s
UNION ALL SELECT 'max', mx FROM s
""")
def describe(spark, sf):
    return P.describe(load(spark, sf, "orders"), "o_totalprice")


_WIDE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"]


@query("correlation_wide", oracle="\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr({a}, {b}), 4) AS correlation FROM lineitem"
    for i, a in enumerate(_WIDE_COLS) for b in _WIDE_COLS[i + 1:]))
def correlation_wide(spark, sf):
    """A8/A9 through the wide-table path (per-task moment matrices)."""
    out = P.correlation_pairs(load(spark, sf, "lineitem"), _WIDE_COLS, method="moments")
    return out.withColumn("correlation", F.round("correlation", 4))
