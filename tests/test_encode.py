import datetime as dt

import pytest
from pyspark.sql import functions as F

from qforge.operators import encode as E
from qforge.operators import geo


def test_ranked_encoder(spark):
    df = spark.createDataFrame([("E3",), ("E5",), ("E4",), ("Unknown",), (None,), ("",)], "Level string")
    enc = E.RankedEncoder.create("Level", {"E3": 0, "E4": 1, "E5": 2})
    assert [r[0] for r in enc.transform(df).select("Level_Enc").collect()] == [0, 2, 1, -1, -1, -1]


def test_ranked_encoder_large_mapping_uses_join(spark):
    mapping = {f"k{i}": i for i in range(1500)}
    df = spark.createDataFrame([("k7",), ("zz",)], "c string")
    got = [r[0] for r in E.RankedEncoder.create("c", mapping).transform(df).select("c_Enc").collect()]
    assert sorted(got) == [-1, 7]


def test_metro_population(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "z int")
    got = [r[0] for r in df.select(geo.metro_population(F.col("z"))).collect()]
    assert got == [5_000_000, 2_000_000, 100_000, 100_000]


def test_date_normalizer(spark):
    rows = [(dt.datetime(2020, 1, 1),), (dt.datetime(2021, 1, 1),), (dt.datetime(2022, 1, 1),), (None,)]
    df = spark.createDataFrame(rows, "Date timestamp")
    for mode in ("normalize_recent", "least_recent"):
        out = [r[0] for r in E.DateNormalizer.create("Date", mode).fit(df).transform(df)
               .select("Date_Normalized").collect()]
        assert out[0] == 0.0 and 0 < out[1] < 1 and out[2] == 1.0 and out[3] == 0.0


def test_date_normalizer_constant(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1),)] * 2, "Date timestamp")
    out = E.DateNormalizer.create("Date").fit(df).transform(df).select("Date_Normalized").collect()
    assert [r[0] for r in out] == [1.0, 1.0]


def test_sample_weighter(spark):
    rows = [(dt.datetime(2023, 1, 1),), (dt.datetime(2022, 1, 1),), (dt.datetime(2021, 1, 1),),
            (dt.datetime(2030, 1, 1),), (None,)]
    df = spark.createDataFrame(rows, "Date timestamp")
    w = [r[0] for r in E.SampleWeighter.create("Date", "2023-01-01", 1.0).fit(df).transform(df)
         .select("weight").collect()]
    assert w[0] == 1.0 and w[1] == pytest.approx(0.5, abs=1e-3) and w[2] == pytest.approx(1 / 3, abs=1e-3)
    assert w[3] == 1.0 and w[4] is None
    w0 = [r[0] for r in E.SampleWeighter.create("Date", "2023-01-01", 0.0).fit(df).transform(df)
          .select("weight").collect()]
    assert w0[:4] == [1.0] * 4


def test_sample_weighter_invalid_dates(spark):
    df = spark.createDataFrame([("nope",), ("never",)], "Date string")
    w = E.SampleWeighter.create("Date", "2023-01-01").fit(df).transform(df).select("weight").collect()
    assert [r[0] for r in w] == [1.0, 1.0]


def test_label_and_onehot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    lab = [r[0] for r in E.LabelEncoder.create("s").fit(df).transform(df).select("s_Label").collect()]
    assert lab == [1, 0, 2, 0]
    oh = E.OneHotEncoder.create("s").fit(df).transform(df)
    assert {"s_a", "s_b", "s_c"} <= set(oh.columns)


def test_proximity_zones(spark, gazetteer):
    targets = {"New York, NY": 1, "San Francisco, CA": 2}
    df = spark.createDataFrame([("Newark",), ("London",), ("Atlantis",), (None,)], "Location string")
    for method in ("geodesic", "haversine"):
        model = E.LocationZoneEncoder.create("Location", targets, 50.0, method=method) \
            .setGazetteer(gazetteer).fit(df)
        got = {r["Location"]: r["Location_Enc"] for r in model.transform(df).collect()}
        assert got == {"Newark": 1, "London": 4, "Atlantis": 4, None: 4}


def test_vincenty():
    d = geo.vincenty_km([40.7128], [-74.0060], [37.7749], [-122.4194])[0]
    assert d == pytest.approx(4138.0, rel=0.01)


def test_label_codes_of_integers_and_one_hot_of_nulls(spark):
    from qforge.operators.encode import LabelEncoder, OneHotEncoder
    for n in (5, 1500):  # literal map and joined table
        df = spark.range(n).selectExpr("id + 10000 as k")
        out = LabelEncoder.create("k").fit(df).transform(df).orderBy("k").collect()
        assert [r["k_Label"] for r in out] == list(range(n))
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    got = OneHotEncoder.create("c").fit(df).transform(df).collect()
    assert [(r["c_a"], r["c_b"]) for r in got] == [(1, 0), (0, 0), (0, 1)]


def test_repeated_gazetteer_names_do_not_repeat_rows(spark):
    from qforge.operators.geo import geocode
    df = spark.createDataFrame([("X",), ("Y",)], "city string")
    gaz = spark.createDataFrame([("X", 2.0, 1.0), ("X", 1.0, 5.0)], "name string, lat double, lon double")
    got = sorted((r["name"], r["lat"], r["lon"]) for r in geocode(df, "city", gaz).collect())
    assert got == [("X", 1.0, 5.0), ("Y", None, None)]


def test_nearest_targets_equal_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    near_pole = np.degrees(np.arccos(rng.uniform(0, 0.03, 150))) * rng.choice([-1, 1], 150)
    lat = np.r_[rng.uniform(-80, 80, 350), near_pole, rng.uniform(50, 52, 300)]
    lon = np.r_[rng.uniform(-180, 180, 350), rng.uniform(-180, 180, 150), rng.choice([-1, 1], 300) * rng.uniform(179, 180, 300)]
    for km in (60.0, 700.0):
        t = rng.choice(len(lat), 120, replace=False)
        tlat, tlon = np.clip(lat[t] + rng.normal(0, 0.3, 120), -90, 90), lon[t]
        points = spark.createDataFrame([(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [("none", None, None)],
                                       "name string, lat double, lon double")
        targets = spark.createDataFrame([(f"t{i}", float(a), float(b), i) for i, (a, b) in enumerate(zip(tlat, tlon))],
                                        "target string, lat double, lon double, ord int")
        got = {r["name"]: (r["target"], r["km"]) for r in geo.nearest_targets(points, targets, km).collect()}
        assert len(got) == len(lat) + 1 and got["none"] == (None, None)
        grid = geo.vincenty_km(*(np.broadcast_to(x, (len(lat), 120)) for x in (lat[:, None], lon[:, None], tlat, tlon)))
        best = np.nanargmin(np.where(np.isnan(grid), np.inf, grid), axis=1)
        found = 0
        for i, b in enumerate(best):
            want = (f"t{b}", grid[i, b]) if grid[i, b] <= km else (None, None)
            assert got[f"p{i}"] == pytest.approx(want) if want[0] is None else (got[f"p{i}"][0] == want[0] and abs(got[f"p{i}"][1] - want[1]) < 1e-9)
            found += want[0] is not None
        assert found > 100


def test_unseen_cities_have_zones_after_reload(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    cities = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("name"), (F.lit(10.0) + F.col("id") * 0.01).alias("lat"),
                                      F.lit(20.0).alias("lon"))
    seen = spark.createDataFrame([("c0",), ("c1",)], "Location string")
    stage = E.LocationZoneEncoder.create("Location", {"c0": 1, "c2000": 2}, 50.0).setGazetteer(cities)
    Pipeline(stages=[stage]).fit(seen).write().save(str(tmp_path / "p"))
    model = PipelineModel.load(str(tmp_path / "p"))
    asked = spark.createDataFrame([("c3",), ("c1999",), ("c1000",), ("nowhere",), (None,)], "Location string")
    assert {r["Location"]: r["Location_Enc"] for r in model.transform(asked).collect()} == {
        "c3": 1, "c1999": 2, "c1000": 4, "nowhere": 4, None: 4}


@pytest.mark.parametrize("n", [4, 200_000])
def test_any_number_of_levels(spark, tmp_path, n):
    df = spark.range(n).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("s"))
    asked = spark.createDataFrame([("v0000003",), ("v0000000",), ("other",), (None,)], "s string")
    label = E.LabelEncoder.create("s").fit(df)
    label.write().save(str(tmp_path / "label"))
    for model in (label, E.LabelModel.load(str(tmp_path / "label"))):
        assert {r["s"]: r["s_Label"] for r in model.transform(asked).collect()} == {"v0000003": 3, "v0000000": 0, "other": -1, None: -1}
    hot = E.OneHotEncoder.create("s", vector=True).fit(df)
    hot.write().save(str(tmp_path / "hot"))
    for model in (hot, E.OneHotVectorModel.load(str(tmp_path / "hot"))):
        got = {r["s"]: r["s_Vector"] for r in model.transform(asked).collect()}
        assert all(v.size == n for v in got.values())
        assert {s: list(map(int, v.indices)) for s, v in got.items()} == {"v0000003": [3], "v0000000": [0], "other": [], None: []}
    if n > 1000:
        with pytest.raises(ValueError):
            E.OneHotEncoder.create("s").fit(df)
