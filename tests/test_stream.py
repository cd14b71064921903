"""Streaming runs that are resumed."""

import pytest
from pyspark.sql import functions as F

from qforge.streaming.stream import read_stream, run_available


def _file(spark, path, low, high):
    spark.range(low, high).coalesce(1).write.mode("append").parquet(path)


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_a_run_goes_on_with_new_files_only(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "runs")
    _file(spark, path, 0, 50)
    stamp = F.current_timestamp().alias("at")
    first = run_available(read_stream(spark, path).select("id", stamp), "unit", root, run_id="r")
    before = {r.id: r["at"] for r in first.collect()}
    _file(spark, path, 50, 80)
    second = run_available(read_stream(spark, path).select("id", stamp), "unit", root, run_id="r")
    after = {r.id: r["at"] for r in second.collect()}
    assert second.count() == 80 and sorted(after) == list(range(80))
    assert all(after[i] == before[i] for i in before)  # not processed again
    assert run_available(read_stream(spark, path).select("id", stamp), "unit", root, run_id="r").count() == 80
    assert run_available(read_stream(spark, path).select("id", stamp), "unit", root).count() == 80  # a run of its own


def test_a_failed_run_is_resumed(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "runs")
    for low in range(0, 60, 20):
        _file(spark, path, low, low + 20)
    stream = read_stream(spark, path, max_files_per_trigger=1)
    broken = stream.select(F.when(F.col("id") == 30, F.raise_error(F.lit("stopped"))).otherwise(F.col("id"))
                           .cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        run_available(broken, "unit", root, run_id="r")
    assert _ids(run_available(stream, "unit", root, run_id="r")) == list(range(60))
