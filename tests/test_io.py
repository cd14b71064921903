import os
import uuid

import pytest

from qforge.sources import csv_quotes as Q
from qforge.sources import io as S


def _write(tmp_path, name, text, mode="w"):
    p = os.path.join(tmp_path, name)
    with open(p, mode) as fh:
        fh.write(text)
    return p


def test_validate_table_messages(spark, tmp_path):
    assert S.validate_table(spark, _write(tmp_path, "empty.csv", "")).error == "File is empty"
    assert S.validate_table(spark, _write(tmp_path, "hdr.csv", "a,b\n")).error == "CSV contains no data rows"
    assert S.validate_table(spark, _write(tmp_path, "one.csv", "a\n1\n2\n")).error == \
        "CSV must have at least 2 columns"
    ok = S.validate_table(spark, _write(tmp_path, "ok.csv", "a,b\n1,x\n2,\n"))
    assert ok.ok and ok.df.count() == 2


def test_validate_table_malformed_rows_without_a_schema(spark, tmp_path):
    wide = S.validate_table(spark, _write(tmp_path, "wide.csv", "a,b\n1,x\n2,y,z\n3,w\n"))
    assert not wide.ok and wide.error.startswith("Failed to parse CSV") and "2,y,z" in wide.error
    short = S.validate_table(spark, _write(tmp_path, "short.csv", "a,b,c\n1,x,\n2\n"))
    assert short.ok and [tuple(r) for r in short.df.orderBy("a").collect()] == [(1, "x", None), (2, None, None)]


def test_read_table_and_json(spark, tmp_path):
    p = _write(tmp_path, "t.csv", "Level,Salary\nE3,100\nE4,150\n")
    df = S.read_table(spark, p)
    assert dict(df.dtypes)["Salary"] in ("int", "bigint", "double")
    j = _write(tmp_path, "arr.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert S.read_json_records(spark, j).count() == 2
    cols, types, n = S.describe_schema(df)
    assert cols == ["Level", "Salary"] and n == 2
    with pytest.raises(ValueError):
        S.describe_schema(spark.range(1).select())


def test_read_json_columns(spark):
    doc = '{"Level": {"0": "E3", "1": "E4"}, "Salary": {"0": "100", "1": "150"}}'
    df = spark.createDataFrame([(doc,)], "j string")
    out = S.read_json_columns(df, "j").orderBy("_idx").collect()
    assert [(r.Level, r.Salary) for r in out] == [("E3", "100"), ("E4", "150")]


def test_keyed_datasets(spark):
    key = f"t-{uuid.uuid4().hex[:6]}"
    S.register_dataset(spark.range(3), key)
    assert S.get_dataset(spark, key).count() == 3
    assert S.drop_dataset(spark, key) is True
    assert S.get_dataset(spark, key) is None and S.drop_dataset(spark, key) is False


def test_quotes_open_at_field_starts_only():
    cases = {'a,b': (False, True), 'a,"b': (True, False), '"a",b': (False, False), '5" pipe,x': (False, False),
             '"a""b",c': (False, False), r'"a\"b",c': (False, False), '"': (True, False), '""': (False, True), '': (False, True),
             'end",x': (False, False), 'end","x': (True, True)}
    for line, (outside, inside) in cases.items():
        assert (Q.after_line(line, False)[0], Q.after_line(line, True)[0]) == (outside, inside), line


@pytest.mark.parametrize("split_bytes", [40, 1 << 20])
def test_unterminated_quote_in_a_file_of_many_splits(spark, tmp_path, split_bytes):
    rows = [f'{i},"line {i}\ngoes on, with ""quotes"" in it",{i}" wide' for i in range(60)]
    good = "id,text,size\n" + "\n".join(rows) + "\n"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = _write(tmp_path, "good.csv", good)
        if split_bytes == 40:
            assert spark.read.text(path).rdd.getNumPartitions() > 20
        ok = S.validate_table(spark, path)
        assert ok.ok and ok.df.count() == 60
        assert ok.df.filter("id = 7").first()["text"] == 'line 7\ngoes on, with "quotes" in it'
        cut = "\n".join(good.split("\n")[:81]) + '\n90,"never closed,1\n' + "\n".join(f"{i},x,y" for i in range(50)) + "\n"
        bad = S.validate_table(spark, _write(tmp_path, "bad.csv", cut))
        at = cut.split("\n").index('90,"never closed,1') + 1
        assert not bad.ok and f"quote opened in line {at} is never closed" in bad.error
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opening)
