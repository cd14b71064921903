import numpy as np
import pytest

from qforge.operators.stats import exact_quantiles


def _np_quantile(vals, p):
    return float(np.quantile(np.asarray(vals, float), p, method="linear"))


@pytest.mark.parametrize("max_bracket", [1_000_000, 50])
def test_exact_quantiles_match_numpy(spark, max_bracket):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, max_bracket=max_bracket)["x"]
    for g, p in zip(got, probs):
        assert g == pytest.approx(_np_quantile(vals, p), abs=1e-12)


def test_exact_quantiles_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [2.0]
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, ["x"], [0.5])["x"] == [None]


def test_global_row_number_matches_sort(spark):
    from qforge.operators.stats import global_row_number
    rows = [(i % 17, f"v{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(6)
    out = global_row_number(df, ["k", "v"], "code", partitions=5).toPandas()
    expect = sorted(rows)
    got = out.sort_values("code")[["k", "v"]].itertuples(index=False)
    assert [tuple(r) for r in got] == expect
    assert sorted(out.code) == list(range(500))
