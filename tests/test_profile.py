import pytest

from qforge.operators import profile as P


def test_column_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,), (None,)], "v double")
    r = P.column_statistics(df).collect()[0]
    assert (r.total_count, r.null_count, r.unique_count) == (6, 1, 5)
    assert r.mean == 3.0 and r.median == 3.0 and r.q25 == 2.0 and r.q75 == 4.0
    assert r.std == pytest.approx(1.5811, abs=1e-4)
    assert r.null_percentage == pytest.approx(16.67)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,)] * 4, "v double")
    r = P.column_statistics(df).collect()[0]
    assert r.null_percentage == 100.0 and r.unique_count == 0 and r.mean is None


def test_value_counts(spark):
    df = spark.createDataFrame([(v,) for v in ["Active", "Active", "Inactive", "Active", "Pending"]], "s string")
    rows = P.value_counts(df, "s").collect()
    assert rows[0].value == "Active" and rows[0]["count"] == 3 and rows[0].total_unique_values == 3
    df2 = spark.createDataFrame([(v,) for v in ["A", "A", "B", None, None, "C"]], "s string")
    pct = {r.value: r.percentage for r in P.value_counts(df2, "s").collect()}
    assert pct["A"] == pytest.approx(100 * 2 / 6)


def test_value_counts_limits(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(1500)], "s string")
    assert P.value_counts(df, "s", 20).count() == 20
    rows = P.value_counts(df, "s", 0).collect()
    assert rows == []


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 4, 4), (3, 6, 3), (4, 8, 2), (5, 10, 1)], "A int, B int, C int")
    c = {(r.column_1, r.column_2): r.correlation for r in P.correlation_pairs(df).collect()}
    assert c[("A", "B")] == pytest.approx(1.0) and c[("A", "C")] == pytest.approx(-1.0)


def test_correlation_errors(spark):
    df = spark.createDataFrame([(1, "x")], "A int, S string")
    with pytest.raises(P.CorrelationError) as e:
        P.correlation_pairs(df)
    assert e.value.detail["numeric_columns"] == ["A"]
    with pytest.raises(P.CorrelationError) as e:
        P.correlation_pairs(df, "A, S, Q")
    assert e.value.detail["not_found"] == ["Q"] and e.value.detail["not_numeric"] == ["S"]


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    assert P.correlation_pairs(df).collect()[0].correlation is None


def test_data_summary(spark):
    df = spark.createDataFrame([("A", "L1"), ("A", "L2"), ("B", "L1")], "Location string, Level string")
    s = P.data_summary(df)
    assert s["total_samples"] == 3 and s["shape"] == (3, 2)
    assert s["unique_location"] == 2 and s["unique_level"] == 2


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (10.0,)], "x double")
    rows = P.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 1]


def test_boolean_and_ratio(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (True,)], "b boolean")
    r = P.boolean_stats(df, "b").collect()[0]
    assert (r.true_count, r.false_count, r.null_count) == (2, 1, 1)
    ratio = P.distinct_ratio(df).collect()[0].unique_ratio
    assert ratio == pytest.approx(0.5)


def test_correlation_moments_match_aggregate(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        a = rnd.gauss(0, 1)
        rows.append((a, 2 * a + rnd.gauss(0, 0.5) if i % 7 else None, rnd.gauss(10, 3), float(i % 5)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    agg = {(r.column_1, r.column_2): r.correlation for r in P.correlation_pairs(df, method="aggregate").collect()}
    mom = {(r.column_1, r.column_2): r.correlation for r in P.correlation_pairs(df, method="moments").collect()}
    assert agg.keys() == mom.keys()
    for k in agg:
        assert mom[k] == pytest.approx(agg[k], abs=1e-9)


def test_approx_statistics_close_to_exact(spark):
    import random
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.gauss(50, 10), f"s{rnd.randint(0, 300)}") for _ in range(5000)],
                               "x double, s string")
    ex = {r.column: r for r in P.column_statistics(df).collect()}
    ap = {r.column: r for r in P.column_statistics(df, approx=True).collect()}
    assert abs(ap["x"].median - ex["x"].median) < 0.5
    assert abs(ap["s"].unique_count - ex["s"].unique_count) <= 0.05 * ex["s"].unique_count


def test_sample_values_booleans_and_order(spark):
    df = spark.createDataFrame([(True,), (None,), (False,), (True,)], "b boolean")
    assert [r.value for r in P.sample_values(df, "b").collect()] == ["0", "1", "1"]


def test_dtype_names(spark):
    df = spark.createDataFrame([(1.0, 2, "a", True)], "a double, b long, c string, d boolean")
    assert [r.dtype for r in P.column_statistics(df).collect()] == ["float64", "int64", "object", "bool"]
