"""End-to-end forecaster on the reference's compensation fixture."""

import numpy as np
import pytest

from qforge.config import ConfigError, FeatureSpec, ForecastConfig
from qforge.operators.forecast import QuantileForecaster, best_round
from qforge.operators.gbt.model import ModelNotFoundError, ModelSet


def _cfg(**kw):
    base = dict(targets=["BaseSalary"], quantiles=[0.25, 0.5, 0.75],
                features=[FeatureSpec("Level_Enc", 1), FeatureSpec("Location_Enc", 0),
                          FeatureSpec("YearsOfExperience", 1), FeatureSpec("YearsAtCompany", 0)],
                mappings={"levels": {"E3": 0, "E4": 1, "E5": 2, "E6": 3, "E7": 4},
                          "location_targets": {"New York": 1, "San Francisco": 2}},
                ranked_cols={"Level": "levels"}, proximity_cols=["Location"], ref_date="2023-01-01",
                training={"max_depth": 3, "eta": 0.3},
                cv={"num_boost_round": 20, "nfold": 3, "early_stopping_rounds": 5})
    base.update(kw)
    return ForecastConfig(**base)


@pytest.fixture(scope="module")
def trained(spark, comp_df, gazetteer):
    return QuantileForecaster(_cfg(), gazetteer).train(comp_df, remove_outliers=True)


def test_monotone_and_ordered(spark, trained, comp_df):
    grid = comp_df.select("Level", "Location", "YearsOfExperience", "YearsAtCompany", "Date").distinct()
    w = trained.predict(grid, "wide").toPandas()
    order = {"E3": 0, "E4": 1, "E5": 2, "E6": 3, "E7": 4}
    for loc, g in w.groupby("Location"):
        g = g.assign(k=g.Level.map(order)).sort_values("k")
        for c in ["BaseSalary_p25", "BaseSalary_p50", "BaseSalary_p75"]:
            assert (np.diff(g[c].to_numpy()) >= -1e-6).all(), (loc, c)
    ny = w[w.Location == "New York"]
    sea = w[w.Location == "Seattle"]
    assert ny.BaseSalary_p50.mean() > sea.BaseSalary_p50.mean()


def test_cv_results(trained):
    assert len(trained.best) == 3
    rep = trained.train_report().collect()
    assert {r.Model for r in rep} == {"BaseSalary_p25", "BaseSalary_p50", "BaseSalary_p75"}
    assert best_round(trained.cv).count() == 3
    assert trained.cv_mean_score() > 0


def test_save_load_roundtrip(spark, trained, comp_df, tmp_path):
    path = str(tmp_path / "models")
    trained.save(path, "run-1")
    ms = ModelSet.load(spark, path, "run-1")
    sample = trained.transform(comp_df.limit(50))
    a = trained.model_set.predict(sample, "long").toPandas().sort_values(["Level", "Location", "quantile"])
    b = ms.predict(sample, "long").toPandas().sort_values(["Level", "Location", "quantile"])
    assert np.allclose(a.prediction.to_numpy(), b.prediction.to_numpy())
    with pytest.raises(ModelNotFoundError):
        ModelSet.load(spark, path, "missing")


def test_config_validation():
    with pytest.raises(ConfigError):
        _cfg(targets=[])
    with pytest.raises(ConfigError):
        _cfg(quantiles=[1.5])
    with pytest.raises(ConfigError):
        _cfg(quantiles=[0.02, 0.025])
    with pytest.raises(ConfigError):
        _cfg(features=[FeatureSpec("a"), FeatureSpec("a")])
    with pytest.raises(ConfigError):
        FeatureSpec("a", 2)
    cfg = _cfg()
    again = ForecastConfig.from_dict(cfg.to_dict())
    assert again.mappings["levels"] == cfg.mappings["levels"] and again.ranked_cols == {"Level": "levels"}
    assert ForecastConfig.model_name("BaseSalary", 0.29) == "BaseSalary_p28"


def test_assemble_finalize_and_optional_checks():
    from qforge.config import assemble_config, check_optional_encodings, default_hyperparameters, finalize_config
    roles = {"targets": ["Salary"], "features": ["Level", "Location", "Years"], "locations": ["Location"]}
    enc = {"Level": {"type": "ordinal", "mapping": {"L1": 0, "L2": 1}},
           "Location": {"type": "proximity", "optional": {"type": "cost_of_living"}},
           "Years": {"type": "numeric"}}
    cfg = assemble_config(roles, enc, {"quantiles": [0.5]})
    assert cfg.mappings["level_mapping"] == {"L1": 0, "L2": 1}
    assert cfg.ranked_cols == {"Level": "level_mapping"} and cfg.proximity_cols == ["Location"]
    assert cfg.feature_names() == ["Level_Enc", "Location_Enc", "Years"]
    assert check_optional_encodings(cfg, {"Location": "location"}) == []
    assert check_optional_encodings(cfg, {"Location": "categorical"})
    cfg2 = finalize_config(cfg, {"quantiles": [0.1, 0.9], "location_settings": {"max_distance_km": 25}})
    assert cfg2.quantiles == [0.1, 0.9] and cfg2.max_distance_km == 25
    assert default_hyperparameters()["training"]["eta"] == 0.1


def test_forecaster_is_loaded_whole(spark, trained, comp_df, tmp_path):
    path = str(tmp_path / "runs")
    trained.save(path, "a")
    trained.save(path, "a")  # replaced, not doubled
    loaded = QuantileForecaster.load(spark, path, "a")
    grid = comp_df.select("Level", "Location", "YearsOfExperience", "YearsAtCompany", "Date").distinct()
    a, b = (sorted(map(tuple, f.predict(grid, "long").collect()), key=str) for f in (trained, loaded))
    assert a == b and len(a) == 3 * grid.count()
    assert loaded.cfg.to_dict() == trained.cfg.to_dict() and loaded.best == trained.best
    assert loaded.train_report().count() == 3 and loaded.cv.count() == trained.cv.count()
    assert loaded.transform(comp_df.limit(5), with_weight=True).count() == 5
    with pytest.raises(ModelNotFoundError):
        QuantileForecaster.load(spark, path, "missing")
