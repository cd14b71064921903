"""Locations (J1-J3, E2-E4 lookups).

The work is done once per *distinct* location: names are geocoded by a
join with a gazetteer table (J3), each distinct point gets the zone of its
nearest target (J1), and the (name -> zone) table is joined back to the
rows -- broadcast only when its row count is checked to be small,
otherwise a shuffle join that AQE can split on skewed names.

Nearest targets are found over a spatial index (``nearest_targets``): every
target is listed under the cells its radius may reach, a point has one cell,
an equi-join on the cell gives the candidates and a partial minimum the
nearest.  Cells are bands of latitude cut into pieces of longitude that
widen towards the poles, so a target has few cells everywhere.
``nearest_zone`` is the same search as a Column for a handful of literal
targets.  Ties keep the first target in config order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import haversine_km

# Zone -> metro population (E4) and the default zone.
METRO_POPULATION = {1: 5_000_000, 2: 2_000_000, 3: 500_000, 4: 100_000}
DEFAULT_ZONE = 4
DEFAULT_POPULATION = 100_000

# WGS-84 ellipsoid
_A = 6378137.0
_F = 1 / 298.257223563
_B = _A * (1 - _F)


def vincenty_km(lat1, lon1, lat2, lon2, max_iter: int = 200) -> np.ndarray:
    """Ellipsoidal distance (Vincenty inverse), vectorised; NaN -> NaN."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, np.float64)) for x in (lat1, lon1, lat2, lon2))
    L = lon2 - lon1
    U1 = np.arctan((1 - _F) * np.tan(lat1))
    U2 = np.arctan((1 - _F) * np.tan(lat2))
    sU1, cU1, sU2, cU2 = np.sin(U1), np.cos(U1), np.sin(U2), np.cos(U2)
    lam = L.copy()
    out = np.full(L.shape, np.nan)
    sin_s = cos_s = sigma = cos2a = cos2sm = np.zeros_like(L)
    for _ in range(max_iter):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.sqrt((cU2 * sl) ** 2 + (cU1 * sU2 - sU1 * cU2 * cl) ** 2)
        cos_s = sU1 * sU2 + cU1 * cU2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(invalid="ignore", divide="ignore"):
            sin_a = np.where(sin_s == 0, 0.0, cU1 * cU2 * sl / sin_s)
            cos2a = 1 - sin_a ** 2
            cos2sm = np.where(cos2a == 0, 0.0, cos_s - 2 * sU1 * sU2 / cos2a)
        C = _F / 16 * cos2a * (4 + _F * (4 - 3 * cos2a))
        lam_new = L + (1 - C) * _F * sin_a * (sigma + C * sin_s * (cos2sm + C * cos_s * (-1 + 2 * cos2sm ** 2)))
        done = np.abs(lam_new - lam) < 1e-12
        lam = lam_new
        if np.all(done | np.isnan(lam)):
            break
    u2 = cos2a * (_A ** 2 - _B ** 2) / _B ** 2
    A = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    B = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    ds = B * sin_s * (cos2sm + B / 4 * (cos_s * (-1 + 2 * cos2sm ** 2)
                                         - B / 6 * cos2sm * (-3 + 4 * sin_s ** 2) * (-3 + 4 * cos2sm ** 2)))
    out = _B * A * (sigma - ds) / 1000.0
    same = (lat1 == lat2) & (lon1 == lon2)
    return np.where(same, 0.0, out)


@F.pandas_udf(T.IntegerType())
def _nearest_zone_udf(lat: pd.Series, lon: pd.Series, tlat: pd.Series, tlon: pd.Series,
                      tzone: pd.Series, max_km: pd.Series) -> pd.Series:
    """Zone of the nearest target by geodesic distance, one batch at a time.

    The target arrays are literals (identical on every row), so the batch
    is scored as an (n rows x targets) grid.
    """
    n = len(lat)
    if n == 0:
        return pd.Series(np.zeros(0, np.int32))
    ta = np.asarray(tlat.iat[0], np.float64)
    to = np.asarray(tlon.iat[0], np.float64)
    tz = np.asarray(tzone.iat[0], np.int64)
    la = lat.to_numpy(np.float64, na_value=np.nan)[:, None]
    lo = lon.to_numpy(np.float64, na_value=np.nan)[:, None]
    d = vincenty_km(np.broadcast_to(la, (n, len(ta))), np.broadcast_to(lo, (n, len(ta))),
                    np.broadcast_to(ta, (n, len(ta))), np.broadcast_to(to, (n, len(ta))))
    d = np.where(np.isnan(d), np.inf, d)
    k = np.argmin(d, axis=1)  # first minimum = first target in config order
    best = d[np.arange(n), k]
    out = np.where(best <= max_km.to_numpy(np.float64), tz[k], DEFAULT_ZONE)
    return pd.Series(out.astype(np.int32))


def target_points(targets: dict[str, int], gazetteer: DataFrame) -> list[tuple[str, float, float, int]]:
    """Geocode the configured targets (config-sized); those without coords are left out."""
    names = list(targets)
    coords = {r["name"]: (r["lat"], r["lon"]) for r in
              gazetteer.filter(F.col("name").isin(names)).select("name", "lat", "lon").collect()}
    return [(n, float(coords[n][0]), float(coords[n][1]), int(targets[n]))
            for n in names if n in coords and coords[n][0] is not None and coords[n][1] is not None]


def nearest_zone(lat: Column, lon: Column, points: list[tuple[str, float, float, int]],
                 max_km: float, method: str = "geodesic") -> Column:
    """J1 as a Column: zone of the nearest target within max_km (inclusive), else 4."""
    if not points:
        return F.lit(DEFAULT_ZONE)
    if method == "geodesic":
        return F.coalesce(_nearest_zone_udf(
            lat.cast("double"), lon.cast("double"),
            F.array(*[F.lit(p[1]) for p in points]), F.array(*[F.lit(p[2]) for p in points]),
            F.array(*[F.lit(p[3]) for p in points]), F.lit(float(max_km))), F.lit(DEFAULT_ZONE))
    tarr = F.array(*[F.struct(F.lit(p[1]).alias("lat"), F.lit(p[2]).alias("lon"),
                              F.lit(i).alias("ord"), F.lit(p[3]).alias("zone"))
                     for i, p in enumerate(points)])
    dists = F.transform(tarr, lambda t: F.struct(
        haversine_km(lat, lon, t["lat"], t["lon"]).alias("d"), t["ord"].alias("ord"),
        t["zone"].alias("zone")))
    best = F.array_min(dists)
    return (F.when(lat.isNull() | lon.isNull(), F.lit(DEFAULT_ZONE))
            .when(best["d"] <= F.lit(float(max_km)), best["zone"])
            .otherwise(F.lit(DEFAULT_ZONE)))


#: Kilometres of a degree of latitude, from below; margin of spherical against ellipsoidal distances.
KM_PER_DEGREE, CELL_MARGIN = 110.5, 1.02


@F.pandas_udf(T.DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Ellipsoidal distance of two columns of points."""
    return pd.Series(vincenty_km(*(x.to_numpy(np.float64, na_value=np.nan) for x in (lat1, lon1, lat2, lon2))))


def _cell_width(band: Column, height: float) -> Column:
    """Degrees of longitude of the cells of a band of latitude: at least ``height`` degrees of arc."""
    edge = F.least(F.greatest(F.abs(band * height), F.abs((band + 1) * height)), F.lit(90.0))
    return F.least(F.lit(height) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9)), F.lit(360.0))


def _cells(lat: Column, lon: Column, band: Column, height: float, reach: int) -> Column:
    """Cells of a band from ``reach`` before to ``reach`` after the one of ``lon``, around the globe.

    The last cell before the date line may be narrow, and near the poles a
    target in the next band reaches further: three cells cover both.
    """
    width = _cell_width(band, height)
    count = F.ceil(F.lit(360.0) / width)
    own = F.floor((F.pmod(lon + 180.0, F.lit(360.0))) / width)
    steps = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    return F.array_distinct(F.transform(steps, lambda k: F.pmod(own + k, count)))


def nearest_targets(points: DataFrame, targets: DataFrame, max_km: float = 50.0, method: str = "geodesic") -> DataFrame:
    """``points(name, lat, lon)`` with ``target`` and ``km`` of the nearest of ``targets(target, lat, lon, ord)``.

    Only targets within ``max_km`` (inclusive) count; a point without one, or
    without coordinates, gets nulls.  Names of points are unique.
    """
    height = max(float(max_km), 1e-3) * CELL_MARGIN / KM_PER_DEGREE
    band = F.floor(F.col("lat") / height)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    near = targets.filter(known).select("target", "ord", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"),
                                        F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    near = near.withColumn("cell", F.explode(_cells(F.col("t_lat"), F.col("t_lon"), F.col("band"), height, 3)))
    placed = points.filter(known).select("name", "lat", "lon", band.alias("band"))
    placed = placed.withColumn("cell", _cells(F.col("lat"), F.col("lon"), F.col("band"), height, 0)[0])
    ends = [F.col(c) for c in ("lat", "lon", "t_lat", "t_lon")]
    km = geodesic_km(*[c.cast("double") for c in ends]) if method == "geodesic" else haversine_km(*ends)
    pairs = placed.join(near, ["band", "cell"]).withColumn("km", km).filter(F.col("km") <= float(max_km))
    best = pairs.groupBy("name").agg(F.min(F.struct("km", "ord", "target")).alias("best"))
    return points.join(best, "name", "left").select(*points.columns, F.col("best.target").alias("target"), F.col("best.km").alias("km"))


def gazetteer_places(gazetteer: DataFrame) -> DataFrame:
    """``(name, lat, lon)`` with each name once: of repeated names the smallest (lat, lon)."""
    return gazetteer.filter(F.col("name").isNotNull()).groupBy("name").agg(
        F.min(F.struct("lat", "lon")).alias("at")).select("name", "at.lat", "at.lon")


def zones_of_places(places: DataFrame, targets: dict[str, int], max_km: float = 50.0,
                    method: str = "geodesic") -> DataFrame:
    """``places`` with the zone of the nearest configured target; others get the default zone."""
    spark = places.sparkSession
    listed = spark.createDataFrame([(n, i, int(z)) for i, (n, z) in enumerate(targets.items())], "target string, ord int, zone int")
    located = listed.join(places.withColumnRenamed("name", "target"), "target")
    near = nearest_targets(places, located.drop("zone"), max_km, method)
    zone = F.coalesce("zone", F.lit(DEFAULT_ZONE)).cast("int").alias("zone")
    return near.join(F.broadcast(listed.drop("ord")), "target", "left").select(*places.columns, zone)


def geocode(df: DataFrame, col: str, gazetteer: DataFrame) -> DataFrame:
    """Distinct names of ``col`` with (lat, lon) from the gazetteer, NULL if unknown."""
    names = df.select(F.col(col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return names.join(gazetteer_places(gazetteer), "name", "left")


def location_zones(df: DataFrame, col: str, targets: dict[str, int], gazetteer: DataFrame,
                   max_km: float = 50.0, method: str = "geodesic") -> DataFrame:
    """J1 on the distinct values of ``col``: (name, lat, lon, zone)."""
    names = df.select(F.col(col).alias("name")).filter(F.col("name").isNotNull()).distinct()
    zones = zones_of_places(gazetteer_places(gazetteer), targets, max_km, method)
    return names.join(zones, "name", "left").fillna({"zone": DEFAULT_ZONE})


def attach_zone(df: DataFrame, col: str, zones: DataFrame, out_col: str) -> DataFrame:
    """Join the per-name zones back; non-strings / unknown names -> 4.

    No static hint: the zones frame is one row per distinct name, and AQE
    turns the join into a broadcast join from the measured shuffle size when
    it is small (``spark.sql.adaptive.autoBroadcastJoinThreshold``), or
    splits skewed names when it is not.
    """
    z = zones.select(F.col("name").alias("__name"), F.col("zone").alias("__zone"))
    joined = df.join(z, df[col] == z["__name"], "left")
    return joined.withColumn(out_col, F.coalesce(F.col("__zone"), F.lit(DEFAULT_ZONE)).cast("int")) \
        .drop("__name", "__zone")


def metro_population(zone: Column) -> Column:
    """Zone -> metro population, anything else -> 100,000."""
    expr = F.lit(DEFAULT_POPULATION)
    for z, pop in sorted(METRO_POPULATION.items(), reverse=True):
        expr = F.when(zone == F.lit(z), F.lit(pop)).otherwise(expr)
    return expr.cast("long")


__all__ = ["vincenty_km", "geodesic_km", "nearest_zone", "nearest_targets", "zones_of_places", "gazetteer_places", "geocode", "location_zones", "attach_zone",
           "metro_population", "target_points"]
