import pytest
from pyspark.sql import functions as F

from qforge.functions.columns import coerce_number, year_range
from qforge.operators import clean as C


def test_year_range(spark):
    df = spark.createDataFrame([("11+",), ("5-10",), ("3",), (" 7 ",), ("-3",), ("abc",), (None,)], "v string")
    got = [r[0] for r in df.select(year_range(F.col("v"))).collect()]
    assert got == [11.0, 7.5, 3.0, 7.0, None, None, None]


def test_year_range_numeric_passthrough(spark):
    df = spark.createDataFrame([(4.0,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(year_range(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [4.0, None]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("10",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce_number("v")).collect()] == [10.0, 0.0, 0.0]


def test_iqr_bounds_and_removal(spark):
    df = spark.createDataFrame([(float(x),) for x in [100, 102, 98, 101, 99, 1000, 100, 100]], "Salary double")
    b = C.iqr_bounds(df, ["Salary"], 1.5)[0]
    assert (b.q1, b.q3) == (99.75, 101.25)
    assert b.upper == pytest.approx(103.5)
    kept, removed = C.remove_outliers(df, ["Salary"], with_counts=True)
    assert removed == 1 and kept.count() == 7


def test_outliers_multi_target(spark):
    rows = list(zip([100, 102, 98, 101, 99, 1000], [150, 152, 148, 151, 149, 1500]))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "BaseSalary double, TotalComp double")
    _, removed = C.remove_outliers(df, ["BaseSalary", "TotalComp"], with_counts=True)
    assert removed >= 1


def test_outliers_edge_cases(spark):
    empty = spark.createDataFrame([], "Salary double, Date string")
    assert C.remove_outliers(empty, ["Salary"], with_counts=True)[1] == 0
    df = spark.createDataFrame([(1.0,), (2.0,)], "Other double")
    kept, removed = C.remove_outliers(df, ["Salary"], with_counts=True)
    assert removed == 0 and kept.count() == 2
    with pytest.raises(NotImplementedError):
        C.remove_outliers(df, ["Other"], method="zscore")


def test_null_target_is_removed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "y double")
    kept, removed = C.remove_outliers(df, ["y"], with_counts=True)
    assert removed == 1


def test_select_features_and_resolve(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "A int, B double, C string")
    assert C.select_features(df, ["B"], ["A", "B"]).columns == ["B", "A"]
    with pytest.raises(ValueError):
        C.select_features(df, ["Z"])
    m = C.resolve_columns(df, " a, c ,zz")
    assert m.matched == ["A"] and m.not_numeric == ["C"] and m.not_found == ["zz"]
    assert C.select_numeric(df) == ["A", "B"] and C.select_categorical(df) == ["C"]
