import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from qforge.operators import clean as C
from qforge.operators import geo
from qforge.operators import profile as P


def test_value_count_ties_break_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", "c"]], "s string")
    assert [r.value for r in P.value_counts(df, "s").collect()] == ["a", "b", "c"]


def test_kde_close_to_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = P.kde(df, "x", grid_size=25, bins=4096).orderBy("point").toPandas()
    h = np.std(x, ddof=1) * len(x) ** -0.2
    exact = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)) for g in out.x]
    assert np.allclose(out.density, exact, atol=2e-3)
    assert np.trapezoid(out.density, out.x) == pytest.approx(1.0, abs=0.02)


def test_bad_value_count(spark):
    df = spark.createDataFrame([("5",), ("5-",), ("x",), (None,), ("3+",)], "YearsOfExperience string")
    assert C.bad_value_count(df, "YearsOfExperience").collect()[0].bad_values == 2


def test_nearest_zone_tie_keeps_config_order(spark):
    pts = [("A", 0.0, 1.0, 1), ("B", 0.0, -1.0, 2)]  # equidistant from (0, 0)
    df = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    for method in ("haversine", "geodesic"):
        z = df.select(geo.nearest_zone(F.col("lat"), F.col("lon"), pts, 500.0, method)).collect()[0][0]
        assert z == 1
        far = df.select(geo.nearest_zone(F.col("lat"), F.col("lon"), pts, 10.0, method)).collect()[0][0]
        assert far == 4


def test_read_stream_single_file_and_run(spark, tmp_path):
    from qforge.streaming.stream import read_stream, run_available
    path = str(tmp_path / "t.parquet")
    spark.range(50).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(path)
    s = read_stream(spark, path)
    assert s.isStreaming
    out = run_available(s.withColumn("w", F.col("v") + 1), "unit", root=str(tmp_path / "runs"))
    assert out.count() == 50 and out.agg(F.sum("w")).collect()[0][0] == sum(2 * i + 1 for i in range(50))


def test_classify_columns_rules(spark):
    from qforge.operators import infer as I
    rows = [(i, f"name {i}", float(100 + i % 7), ["NY", "SF"][i % 2], None if i % 3 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "emp_id long, full_name string, salary double, city string, rare double")
    roles = I.classify_columns(df)
    assert roles["targets"] == ["salary"]
    assert "emp_id" in roles["ignore"] and "full_name" in roles["ignore"] and "rare" in roles["ignore"]
    assert roles["column_types"]["city"] == "location" and "city" in roles["features"]


def test_legacy_config_layout():
    from qforge.config import ForecastConfig
    cfg = ForecastConfig.from_dict({
        "mappings": {"levels": {"E3": 0, "E4": 1}, "location_targets": {"New York, NY": 1}},
        "model": {"targets": ["BaseSalary"], "features": [{"name": "Level_Enc", "monotone_constraint": 1}]}})
    assert cfg.ranked_cols == {"Level": "levels"} and cfg.proximity_cols == ["Location"]
    assert cfg.quantiles == [0.1, 0.25, 0.5, 0.75, 0.9] and cfg.cv["nfold"] == 5


def test_tune_writes_best_params(spark, comp_df, gazetteer):
    from qforge.config import FeatureSpec, ForecastConfig
    from qforge.operators.forecast import QuantileForecaster
    cfg = ForecastConfig(targets=["BaseSalary"], quantiles=[0.5],
                         features=[FeatureSpec("Level_Enc", 1), FeatureSpec("YearsOfExperience", 1)],
                         mappings={"levels": {"E3": 0, "E4": 1, "E5": 2, "E6": 3, "E7": 4}, "location_targets": {}},
                         ranked_cols={"Level": "levels"}, ref_date="2023-01-01")
    fc = QuantileForecaster(cfg, gazetteer)
    best, table = fc.tune(comp_df.limit(800), n_trials=2, nfold=2, num_boost_round=3, early_stopping_rounds=2)
    rows = table.collect()
    assert len(rows) == 2 and all(r.score > 0 for r in rows)
    assert fc.cfg.training["max_depth"] == best.max_depth and 0.01 <= fc.cfg.training["eta"] <= 0.3
