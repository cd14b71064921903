"""Feature encoders (E1-E13) as Spark ML stages.

Each encoder is a ``Transformer`` (or an ``Estimator`` when it needs data
statistics) whose body is a Column expression, so a fitted pipeline is a
single projection inside whole-stage codegen; parameters are JSON strings
so stages persist with ``DefaultParamsWritable``.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml import feature as ml
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import date_epoch_micros, literal_epoch_micros
from . import geo
from .stats import global_row_number

UNKNOWN_CODE = -1
# above this many keys a mapping becomes a broadcast join instead of a map literal
MAP_LITERAL_MAX = 1000


class _JsonParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "input column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)
    spec = Param(Params._dummy(), "spec", "JSON parameters", TypeConverters.toString)

    def _spec(self) -> dict:
        return json.loads(self.getOrDefault(self.spec)) if self.isDefined(self.spec) else {}

    def _in(self) -> str:
        return self.getOrDefault(self.inputCol)

    def _out(self) -> str:
        return self.getOrDefault(self.outputCol)


class _Stage(Transformer, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, spec: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._in() not in df.columns:  # encoders skip absent columns (E12)
            return df
        return df.withColumn(self._out(), self.expression(F.col(self._in()), df.schema[self._in()].dataType))

    def expression(self, c: Column, dtype: T.DataType) -> Column:  # pragma: no cover
        raise NotImplementedError


# -- E1 ---------------------------------------------------------------------
class RankedEncoder(_Stage):
    """Mapping lookup; unknown, NULL or non-string -> -1 (int)."""

    @staticmethod
    def create(col: str, mapping: dict | None = None, config=None, key: str | None = None):
        if mapping is None:
            if key is not None:
                if config is None:
                    raise ValueError("a mapping key needs a config")
                mapping = config.mapping(key)
            else:
                mapping = {}
        return RankedEncoder(inputCol=col, outputCol=f"{col}_Enc", spec=json.dumps({"mapping": mapping}))

    def mapping(self) -> dict:
        return self._spec().get("mapping", {})

    def expression(self, c: Column, dtype: T.DataType) -> Column:
        m = self.mapping()
        if not m:
            return F.lit(UNKNOWN_CODE).cast("int")
        lit_map = F.create_map(*[x for k, v in m.items() for x in (F.lit(str(k)), F.lit(int(v)))])
        return F.coalesce(F.try_element_at(lit_map, self._key(c, dtype)), F.lit(UNKNOWN_CODE)).cast("int")

    def _key(self, c: Column, dtype: T.DataType) -> Column:
        """Lookup key: a non-string value matches no string key unless the encoder casts."""
        if self._spec().get("cast") or isinstance(dtype, T.StringType):
            return c.cast("string")
        return F.lit(None).cast("string")

    def _transform(self, df: DataFrame) -> DataFrame:
        m = self.mapping()
        if self._in() not in df.columns or len(m) <= MAP_LITERAL_MAX:
            return super()._transform(df)
        spark = df.sparkSession
        table = spark.createDataFrame([(str(k), int(v)) for k, v in m.items()], "__k string, __v int")
        # the mapping is configuration: its size is known, so broadcasting it is bounded
        key = self._key(F.col(self._in()), df.schema[self._in()].dataType)
        joined = df.join(F.broadcast(table), key == F.col("__k"), "left")
        return joined.withColumn(self._out(), F.coalesce(F.col("__v"), F.lit(UNKNOWN_CODE)).cast("int")) \
            .drop("__k", "__v")


# -- models with tables ---------------------------------------------------------
class _TableWriter(DefaultParamsWriter):
    """Parameters as usual, and the model's table as Parquet next to them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        if self.instance.table is not None:
            self.instance.table.write.parquet(f"{path}/table")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        if model._spec().get("has_table"):
            model.table = SparkSession.active().read.parquet(f"{path}/table")
        return model


class _TableModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted stage that looks its input up in a table of any size (an equi-join)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.table: DataFrame | None = None

    @classmethod
    def fitted(cls, inputCol: str, outputCol: str, spec: dict, table: DataFrame | None):
        model = cls(inputCol=inputCol, outputCol=outputCol, spec=json.dumps({**spec, "has_table": table is not None}))
        model.table = table
        return model

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    def _looked_up(self, df: DataFrame, key: Column, name: str, value: str, out: str) -> DataFrame:
        """``df`` with ``value`` of the table's row whose ``name`` is ``key`` (names are unique) as ``out``.

        No hint: adaptive execution broadcasts the table if it is measured to
        be small, and splits frequent keys of the shuffle join if it is not.
        """
        table = self.table.select(F.col(name).alias("__key"), F.col(value).alias("__value"))
        return df.join(table, key == F.col("__key"), "left").withColumn(out, F.col("__value")).drop("__key", "__value")


# -- E2/E3/E4 ----------------------------------------------------------------
class LocationZoneEncoder(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Zone of the nearest target city.

    ``fit`` ties the targets to a gazetteer: every place of it has a zone
    (J1 over a spatial index), whether the fitted data name it or not.
    ``kind`` = "zone" (E2, E3) or "population" (E4).
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.gazetteer = None

    def setGazetteer(self, gazetteer: DataFrame):
        self.gazetteer = gazetteer
        return self

    def _fit(self, df: DataFrame):
        model = LocationZoneModel.fitted(self._in(), self._out(), self._spec(), None)
        return model.setGazetteer(self.gazetteer) if self.gazetteer is not None else model

    @staticmethod
    def create(col: str, targets: dict, max_km: float = 50.0, kind: str = "zone", suffix: str = "_Enc",
               method: str = "geodesic"):
        return LocationZoneEncoder(inputCol=col, outputCol=f"{col}{suffix}", spec=json.dumps(
            {"targets": targets, "max_km": max_km, "kind": kind, "method": method}))


class LocationZoneModel(_TableModel):
    """Zones of all places of the gazetteer; unknown names and values that are no strings get the default zone."""

    def setGazetteer(self, gazetteer: DataFrame):
        s = self._spec()
        self.table = geo.zones_of_places(geo.gazetteer_places(gazetteer), s.get("targets", {}), s.get("max_km", 50.0),
                                         s.get("method", "geodesic")).select("name", "zone")
        self._set(spec=json.dumps({**s, "has_table": True}))
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        col, out = self._in(), self._out()
        if col not in df.columns:
            return df
        if self.table is None or not isinstance(df.schema[col].dataType, T.StringType):
            found = df.withColumn(out, F.lit(geo.DEFAULT_ZONE))
        else:
            found = self._looked_up(df, df[col], "name", "zone", out)
        zone = F.coalesce(F.col(out), F.lit(geo.DEFAULT_ZONE)).cast("int")
        return found.withColumn(out, geo.metro_population(zone) if self._spec().get("kind") == "population" else zone)


# -- E5/E6 -------------------------------------------------------------------
class DateNormalizer(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """E5: learns min/max of the parsable dates."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def create(col: str, mode: str = "normalize_recent"):
        return DateNormalizer(inputCol=col, outputCol=f"{col}_Normalized", spec=json.dumps({"mode": mode}))

    def _fit(self, df: DataFrame):
        col = self._in()
        lo = hi = None
        if col in df.columns:
            d = date_epoch_micros(F.col(col), df.schema[col].dataType)
            row = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).collect()[0]
            lo, hi = row["lo"], row["hi"]
        return DateNormalizerModel(inputCol=col, outputCol=self._out(),
                                   spec=json.dumps({**self._spec(), "min": lo, "max": hi}))


class DateNormalizerModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - min) / (max - min) in seconds, NULL -> 0, clipped to [0, 1].

    A zero range gives 1.0 for every row; no parsable date at fit time gives
    0.0 (T12).  Both modes compute the same value, as in the reference.
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self._in()
        if col not in df.columns:
            return df
        s = self._spec()
        lo, hi = s.get("min"), s.get("max")
        if lo is None:
            return df.withColumn(self._out(), F.lit(0.0))
        if hi == lo:
            return df.withColumn(self._out(), F.lit(1.0))
        x = date_epoch_micros(F.col(col), df.schema[col].dataType)
        v = (x - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
        return df.withColumn(self._out(), F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


# -- E7 ----------------------------------------------------------------------
def recency_weight(date_us: Column, ref_date: str | dt.datetime, k: float = 1.0) -> Column:
    """(1 + max(floor(days)/365.25, 0)) ** -k; NULL date -> NULL (T5).

    ``date_us`` is the date as epoch microseconds (``date_epoch_micros``).
    """
    ref_us = F.lit(literal_epoch_micros(ref_date))
    days = F.floor((ref_us - date_us) / F.lit(86_400_000_000))
    age = F.greatest(days / F.lit(365.25), F.lit(0.0))
    return F.when(date_us.isNotNull(), F.pow(F.lit(1.0) + age, F.lit(-float(k))))


class SampleWeighter(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Recency weights from a date column and a fixed reference date."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def create(date_col: str = "Date", ref_date: str | None = None, k: float = 1.0, out: str = "weight"):
        """``ref_date=None`` means the latest date in the fitted data (the
        reference uses the wall clock, which makes runs unrepeatable)."""
        return SampleWeighter(inputCol=date_col, outputCol=out,
                              spec=json.dumps({"ref_date": ref_date, "k": k}))

    def _fit(self, df: DataFrame):
        col = self._in()
        spec = self._spec()
        any_valid = False
        if col in df.columns:
            d = date_epoch_micros(F.col(col), df.schema[col].dataType)
            row = df.agg(F.count(d).alias("n"), F.max(d).alias("mx")).collect()[0]
            any_valid = row["n"] > 0
            if spec.get("ref_date") is None and row["mx"] is not None:
                spec["ref_date"] = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=row["mx"])).isoformat(sep=" ")
        return SampleWeighterModel(inputCol=col, outputCol=self._out(),
                                   spec=json.dumps({**spec, "any_valid": any_valid}))


class SampleWeighterModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self._spec()
        col = self._in()
        if col not in df.columns or not s.get("any_valid"):  # T5: absent / all invalid -> 1.0
            return df.withColumn(self._out(), F.lit(1.0))
        d = date_epoch_micros(F.col(col), df.schema[col].dataType)
        return df.withColumn(self._out(), recency_weight(d, s["ref_date"], s.get("k", 1.0)))


# -- E9 ----------------------------------------------------------------------
class NumericPassthrough(_Stage):
    """Listed numeric features, cast to double (NaN -> NULL)."""

    def expression(self, c: Column, dtype: T.DataType) -> Column:
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


# -- E10/E11 -----------------------------------------------------------------
def level_codes(df: DataFrame, col: str) -> DataFrame:
    """``(level, code)``: the distinct values of ``col`` as text with their place in alphabetical order."""
    levels = df.select(F.col(col).cast("string").alias("level")).filter(F.col("level").isNotNull()).distinct()
    return global_row_number(levels, ["level"], "code")


class LabelEncoder(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Alphabetical codes 0..k-1 (NULL / unseen -> -1), for any number of levels."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def create(col: str):
        return LabelEncoder(inputCol=col, outputCol=f"{col}_Label", spec=json.dumps({}))

    def _fit(self, df: DataFrame):
        return LabelModel.fitted(self._in(), self._out(), self._spec(), level_codes(df, self._in()))


class LabelModel(_TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        if self._in() not in df.columns:
            return df
        found = self._looked_up(df, F.col(self._in()).cast("string"), "level", "code", self._out())
        return found.withColumn(self._out(), F.coalesce(F.col(self._out()), F.lit(UNKNOWN_CODE)).cast("int"))


class OneHotEncoder(Estimator, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Alphabetical levels, as one 0/1 column each or, ``vector=True``, as one sparse vector.

    Columns are for few levels: a plan cannot hold any number of them
    (``max_levels``).  The vector has one place a level, all zero for NULL
    and unseen values, and takes any number of levels.
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def create(col: str, max_levels: int = 1000, vector: bool = False):
        return OneHotEncoder(inputCol=col, outputCol=f"{col}_Vector" if vector else col,
                             spec=json.dumps({"max_levels": max_levels, "vector": vector}))

    def _fit(self, df: DataFrame):
        col, s = self._in(), self._spec()
        if s.get("vector"):
            codes = level_codes(df, col)
            return OneHotVectorModel.fitted(col, self._out(), {"size": codes.count()}, codes)
        return OneHotModel(inputCol=col, outputCol=self._out(),
                           spec=json.dumps({"levels": distinct_levels(df, col, s.get("max_levels", 1000))}))


class OneHotVectorModel(_TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        if self._in() not in df.columns:
            return df
        size, out = self._spec()["size"], self._out()
        found = self._looked_up(df, F.col(self._in()).cast("string"), "level", "code", out)
        code = f"{out}__code"
        # values without a level stand after the last one, and that place is dropped
        found = found.withColumn(code, F.coalesce(F.col(out), F.lit(size)).cast("double")).drop(out)
        last = df.sparkSession.range(1).select(F.lit(float(size)).alias(code))
        spread = ml.OneHotEncoder(inputCols=[code], outputCols=[out], dropLast=True).fit(last)
        return spread.transform(found).drop(code)


class OneHotModel(Model, _JsonParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self._in()
        if col not in df.columns:
            return df
        return df.withColumns({f"{self._out()}_{lvl}": F.col(col).cast("string").eqNullSafe(F.lit(lvl)).cast("int")
                               for lvl in self._spec()["levels"]})


def distinct_levels(df: DataFrame, col: str, max_levels: int) -> list[str]:
    """Sorted distinct non-null values; more than ``max_levels`` need the vector form."""
    levels = (df.select(F.col(col).cast("string").alias("v")).filter(F.col("v").isNotNull())
              .distinct().orderBy("v").limit(max_levels + 1).collect())
    if len(levels) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels: use OneHotEncoder.create(col, vector=True)")
    return [r["v"] for r in levels]


# -- E12/E13 ------------------------------------------------------------------
def build_pipeline(cfg, gazetteer: DataFrame | None = None, method: str = "geodesic") -> Pipeline:
    """E13 + E12: config -> ordered stages (ranked, proximity, optional)."""
    stages = []
    for col, key in cfg.ranked_cols.items():
        mapping = key if isinstance(key, dict) else cfg.mapping(key)
        stages.append(RankedEncoder.create(col, mapping))
    targets = cfg.mappings.get("location_targets", {})
    for col in cfg.proximity_cols:
        stages.append(LocationZoneEncoder.create(col, targets, cfg.max_distance_km, "zone", "_Enc",
                                                 method).setGazetteer(gazetteer))
    for col, enc in cfg.optional_encodings.items():
        kind = enc.get("type") if isinstance(enc, dict) else enc
        if kind == "cost_of_living":
            stages.append(LocationZoneEncoder.create(col, targets, cfg.max_distance_km, "zone",
                                                     "_CostOfLiving", method).setGazetteer(gazetteer))
        elif kind == "metro_population":
            stages.append(LocationZoneEncoder.create(col, targets, cfg.max_distance_km, "population",
                                                     "_MetroPopulation", method).setGazetteer(gazetteer))
        elif kind in ("normalize_recent", "least_recent"):
            stages.append(DateNormalizer.create(col, kind))
    return Pipeline(stages=stages)


def weight_stage(cfg) -> SampleWeighter:
    """A ``weight_recent`` optional encoding redirects the date column."""
    date_col = cfg.date_col or "Date"
    for col, enc in cfg.optional_encodings.items():
        if (enc.get("type") if isinstance(enc, dict) else enc) == "weight_recent":
            date_col = col
    return SampleWeighter.create(date_col, cfg.ref_date, cfg.sample_weight_k)


__all__ = ["RankedEncoder", "LocationZoneEncoder", "DateNormalizer", "SampleWeighter",
           "NumericPassthrough", "LabelEncoder", "OneHotEncoder", "build_pipeline", "weight_stage",
           "recency_weight", "distinct_levels"]
