"""Registered inference, encoding and location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import geo
from ..operators import infer as I
from .registry import load, query

_NUM = r"(\d+)"


@query("infer_levels", oracle=r"""
WITH d AS (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL),
 k AS (SELECT value, coalesce(TRY_CAST(regexp_extract(value, '(\d+)', 1) AS BIGINT), -1) AS rank FROM d)
SELECT value, rank, CAST(row_number() OVER (ORDER BY rank, value) - 1 AS INTEGER) AS code FROM k
""")
def infer_levels(spark, sf):
    return I.infer_levels(load(spark, sf, "orders"), "o_orderpriority")


@query("infer_locations", oracle="""
SELECT DISTINCT c_mktsegment AS value, CAST(2 AS INTEGER) AS tier FROM customer WHERE c_mktsegment IS NOT NULL
""")
def infer_locations(spark, sf):
    return I.infer_locations(load(spark, sf, "customer"), "c_mktsegment")


@query("detect_ordinal_numeric", oracle=r"""
WITH d AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL),
 k AS (SELECT value, TRY_CAST(regexp_extract(value, '(\d+)', 1) AS BIGINT) AS order_key FROM d)
SELECT value, order_key, CAST(row_number() OVER (ORDER BY order_key, value) - 1 AS INTEGER) AS code
FROM k WHERE order_key IS NOT NULL
""")
def detect_ordinal_numeric(spark, sf):
    return I.detect_ordinal(load(spark, sf, "part"), "p_brand").mapping


_TITLE_SQL = ("CASE c_nationkey % 5 WHEN 0 THEN 'Junior Analyst' WHEN 1 THEN 'Senior Engineer' "
              "WHEN 2 THEN 'Staff Engineer' WHEN 3 THEN 'Lead Designer' "
              "ELSE 'Principal ' || c_mktsegment END")
_KW_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(value), '{k}') THEN {r}" for k, r in I.ORDINAL_KEYWORDS.items()) + " END"


def _titles(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_nationkey") % 5
    title = (F.when(k == 0, F.lit("Junior Analyst")).when(k == 1, F.lit("Senior Engineer"))
             .when(k == 2, F.lit("Staff Engineer")).when(k == 3, F.lit("Lead Designer"))
             .otherwise(F.concat(F.lit("Principal "), F.col("c_mktsegment"))))
    return c.select(title.alias("title"))


@query("detect_ordinal_keywords", oracle=f"""
WITH d AS (SELECT DISTINCT {_TITLE_SQL} AS value FROM customer),
 k AS (SELECT value, CAST({_KW_SQL} AS BIGINT) AS order_key FROM d)
SELECT value, order_key, CAST(row_number() OVER (ORDER BY order_key, value) - 1 AS INTEGER) AS code
FROM k WHERE order_key IS NOT NULL
""")
def detect_ordinal_keywords(spark, sf):
    return I.detect_ordinal(_titles(spark, sf), "title").mapping


_ROMANS = list(I.ROMAN_VALUES)


@query("detect_ordinal_roman", oracle=f"""
WITH d AS (SELECT DISTINCT 'Tier ' || (['{"','".join(_ROMANS)}'])[p_size % 10 + 1] || ' ' || p_type AS value
           FROM part),
 k AS (SELECT value, CAST(CASE upper(regexp_extract(value, '(?i)\\b(I{{1,3}}|IV|V|VI{{0,3}}|IX|X)\\b', 1))
        {" ".join(f"WHEN '{r}' THEN {v}" for r, v in I.ROMAN_VALUES.items())} END AS BIGINT) AS order_key FROM d)
SELECT value, order_key, CAST(row_number() OVER (ORDER BY order_key, value) - 1 AS INTEGER) AS code
FROM k WHERE order_key IS NOT NULL
""")
def detect_ordinal_roman(spark, sf):
    p = load(spark, sf, "part")
    roman = F.element_at(F.array(*[F.lit(r) for r in _ROMANS]), (F.col("p_size") % 10 + 1).cast("int"))
    tiers = p.select(F.concat(F.lit("Tier "), roman, F.lit(" "), F.col("p_type")).alias("tier"))
    return I.detect_ordinal(tiers, "tier").mapping


def _sem_sql(col: str, kind: str) -> str:
    u = f"count(DISTINCT {col})"
    r = f"CAST({u} AS DOUBLE) / count(*)"
    if kind == "ts":
        rule = "'datetime'"
    elif kind == "int":
        idlike = any(k in col.lower() for k in ("id", "key", "index"))
        rule = (f"CASE WHEN count(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN (0, 1)) = 0 THEN 'boolean' "
                + (f"WHEN {r} > 0.9 THEN 'identifier' " if idlike else "")
                + f"WHEN {u} < 20 THEN 'categorical' ELSE 'numeric_discrete' END")
    elif kind == "double":
        idlike = any(k in col.lower() for k in ("id", "key", "index"))
        rule = (f"CASE WHEN count(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN (0, 1)) = 0 THEN 'boolean' "
                + (f"WHEN {r} > 0.9 THEN 'identifier' " if idlike else "")
                + "ELSE 'numeric_continuous' END")
    else:
        loc = any(k in col.lower() for k in I.LOCATION_KEYWORDS)
        idn = any(k in col.lower() for k in ("id", "key", "name"))
        parts = [f"WHEN count(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN "
                 f"('True', 'False', 'true', 'false')) = 0 THEN 'boolean'"]
        if loc:
            parts.append("WHEN true THEN 'location'")
        parts.append(f"WHEN {r} > 0.8 THEN '{'identifier' if idn else 'text'}'")
        rule = "CASE " + " ".join(parts) + " ELSE 'categorical' END"
    return (f"SELECT '{col}' AS \"column\", {rule} AS semantic_type, {u} AS unique_count, "
            f"round({r}, 4) AS unique_ratio FROM orders")


_SEM_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
             ("o_totalprice", "double"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]


@query("semantic_types", oracle="\nUNION ALL\n".join(_sem_sql(c, k) for c, k in _SEM_COLS))
def semantic_types(spark, sf):
    return I.semantic_types(load(spark, sf, "orders")).drop("reasoning")


# -- encoders ------------------------------------------------------------------
_PRIORITY_MAP = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}


@query("ranked_encode", oracle="""
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
       WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE -1 END AS INTEGER) AS o_orderpriority_Enc
FROM orders
""")
def ranked_encode(spark, sf):
    o = load(spark, sf, "orders")
    enc = E.RankedEncoder.create("o_orderpriority", _PRIORITY_MAP)
    return enc.transform(o).select("o_orderkey", "o_orderpriority_Enc")


@query("date_normalize", oracle="""
WITH m AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM orders)
SELECT o_orderkey, coalesce(least(greatest(CAST(epoch_us(o_orderdate) - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE),
       0.0), 1.0), 0.0) AS o_orderdate_Normalized
FROM orders, m
""")
def date_normalize(spark, sf):
    o = load(spark, sf, "orders")
    model = E.DateNormalizer.create("o_orderdate", "normalize_recent").fit(o)
    return model.transform(o).select("o_orderkey", "o_orderdate_Normalized")


@query("sample_weight", oracle="""
SELECT o_orderkey,
       round(pow(1.0 + greatest(floor((epoch_us(TIMESTAMP '1999-01-01 00:00:00') - epoch_us(o_orderdate))
             / 86400000000.0) / 365.25, 0.0), -1.0), 12) AS weight
FROM orders
""")
def sample_weight(spark, sf):
    o = load(spark, sf, "orders")
    model = E.SampleWeighter.create("o_orderdate", "1999-01-01 00:00:00", 1.0).fit(o)
    return model.transform(o).select("o_orderkey", F.round("weight", 12).alias("weight"))


@query("onehot_encode", oracle="""
SELECT l_orderkey, l_linenumber,
       CAST(l_returnflag = 'A' AS INTEGER) AS l_returnflag_A,
       CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N,
       CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R
FROM lineitem
""")
def onehot_encode(spark, sf):
    li = load(spark, sf, "lineitem")
    model = E.OneHotEncoder.create("l_returnflag").fit(li)
    return model.transform(li).select("l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N",
                                      "l_returnflag_R")


@query("label_encode", oracle="""
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_Label
FROM customer
""")
def label_encode(spark, sf):
    c = load(spark, sf, "customer")
    model = E.LabelEncoder.create("c_mktsegment").fit(c)
    return model.transform(c).select("c_custkey", "c_mktsegment_Label")


# -- locations -----------------------------------------------------------------
# Fixed values for the location queries: a gazetteer derived from the nation
# table (a grid around 40N 74W, 0.2 deg x 0.25 deg) and three target cities.
ZONE_TARGETS = {"NATION_0": 1, "NATION_13": 2, "NATION_21": 3}
ZONE_MAX_KM = 40.0
_GAZ_SQL = ("SELECT n_name AS name, CAST(40.0 AS DOUBLE) + (n_nationkey % 5) * CAST(0.2 AS DOUBLE) AS lat, "
            "CAST(-74.0 AS DOUBLE) + floor(n_nationkey / 5) * CAST(0.25 AS DOUBLE) AS lon FROM nation")
_LOC_SQL = ("CASE WHEN c_custkey % 10 = 0 THEN 'Atlantis' ELSE n_name END")


def _gazetteer(spark, sf):
    n = load(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name"),
                    (F.lit(40.0) + (F.col("n_nationkey") % 5) * F.lit(0.2)).alias("lat"),
                    (F.lit(-74.0) + F.floor(F.col("n_nationkey") / 5) * F.lit(0.25)).alias("lon"))


def _customer_locations(spark, sf):
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    loc = F.when(F.col("c_custkey") % 10 == 0, F.lit("Atlantis")).otherwise(F.col("n_name"))
    return j.select("c_custkey", loc.alias("location"))


_HAV = ("2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(t.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * "
        "cos(radians(t.lat)) * pow(sin(radians(t.lon - g.lon) / 2), 2), 1.0)))")
_ZONES_SQL = f"""
gaz AS ({_GAZ_SQL}),
tg AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(ZONE_TARGETS.items()))})
       AS v(name, zone, ord)),
tp AS (SELECT tg.name, tg.zone, tg.ord, gaz.lat, gaz.lon FROM tg JOIN gaz ON tg.name = gaz.name),
locs AS (SELECT DISTINCT {_LOC_SQL} AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT locs.name, gaz.lat, gaz.lon FROM locs LEFT JOIN gaz ON locs.name = gaz.name),
d AS (SELECT g.name, {_HAV} AS dist, t.ord, t.zone FROM g JOIN tp t ON true WHERE g.lat IS NOT NULL),
best AS (SELECT name, zone, dist FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, ord) AS rn
          FROM d) WHERE rn = 1),
z AS (SELECT g.name, CASE WHEN best.dist <= {ZONE_MAX_KM} THEN best.zone ELSE 4 END AS zone
      FROM g LEFT JOIN best ON g.name = best.name)
"""


@query("location_zones", oracle=f"""
WITH {_ZONES_SQL}
SELECT g.name, g.lat, g.lon, CAST(coalesce(z.zone, 4) AS INTEGER) AS zone
FROM g JOIN z ON g.name = z.name
""")
def location_zones(spark, sf):
    locs = _customer_locations(spark, sf)
    return geo.location_zones(locs, "location", ZONE_TARGETS, _gazetteer(spark, sf), ZONE_MAX_KM,
                              method="haversine")


@query("proximity_encode", oracle=f"""
WITH {_ZONES_SQL},
 c AS (SELECT c_custkey, {_LOC_SQL} AS location FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, location, CAST(coalesce(z.zone, 4) AS INTEGER) AS location_Enc,
       CAST(coalesce(z.zone, 4) AS INTEGER) AS location_CostOfLiving,
       CAST(CASE coalesce(z.zone, 4) WHEN 1 THEN 5000000 WHEN 2 THEN 2000000 WHEN 3 THEN 500000
            ELSE 100000 END AS BIGINT) AS location_MetroPopulation
FROM c LEFT JOIN z ON c.location = z.name
""")
def proximity_encode(spark, sf):
    locs = _customer_locations(spark, sf)
    gaz = _gazetteer(spark, sf)
    stages = [E.LocationZoneEncoder.create("location", ZONE_TARGETS, ZONE_MAX_KM, "zone", "_Enc",
                                           "haversine").setGazetteer(gaz),
              E.LocationZoneEncoder.create("location", ZONE_TARGETS, ZONE_MAX_KM, "zone", "_CostOfLiving",
                                           "haversine").setGazetteer(gaz),
              E.LocationZoneEncoder.create("location", ZONE_TARGETS, ZONE_MAX_KM, "population",
                                           "_MetroPopulation", "haversine").setGazetteer(gaz)]
    from pyspark.ml import Pipeline
    return Pipeline(stages=stages).fit(locs).transform(locs)


@query("nearest_targets_geodesic", oracle=f"""
WITH gaz AS ({_GAZ_SQL})
SELECT name, lat, lon, name AS target, CAST(0.0 AS DOUBLE) AS km FROM gaz
""")
def nearest_targets_geodesic(spark, sf):
    """Nearest place of each place of the gazetteer by geodesic distance: itself, at 0 km."""
    gaz = _gazetteer(spark, sf)
    targets = gaz.withColumn("ord", F.hash("name")).withColumnRenamed("name", "target")
    return geo.nearest_targets(gaz, targets, ZONE_MAX_KM)


@query("geocode_join", oracle=f"""
WITH gaz AS ({_GAZ_SQL}),
 locs AS (SELECT DISTINCT {_LOC_SQL} AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT locs.name, gaz.lat, gaz.lon FROM locs LEFT JOIN gaz ON locs.name = gaz.name
""")
def geocode_join(spark, sf):
    return geo.geocode(_customer_locations(spark, sf), "location", _gazetteer(spark, sf))


@query("unmapped_levels", oracle="""
SELECT DISTINCT o_orderpriority AS value FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
""")
def unmapped_levels(spark, sf):
    """Levels present in the data but missing from a mapping (left anti join)."""
    from ..operators.clean import missing_values
    o = load(spark, sf, "orders")
    levels = o.select(F.col("o_orderpriority").alias("value")).filter(F.col("value").isNotNull()).distinct()
    mapping = spark.createDataFrame([(k,) for k in _PRIORITY_MAP], "value string")
    return missing_values(levels, F.broadcast(mapping), "value")
