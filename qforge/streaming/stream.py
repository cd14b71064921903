"""Structured Streaming entry points (§2.14).

The reference has no streaming; what carries over is that cleaning,
encoding (E1-E7), scoring (P1-P3) and usage costing (M5) are stateless
per-row logic, so the very same functions apply to a streaming DataFrame.
``run_available`` drains a file source with ``trigger(availableNow=True)``
into a Parquet sink under the session's shared checkpoint folder and hands
back a batch DataFrame over the sink.  A run with a ``run_id`` has a fixed
sink and checkpoint: a later call, also of another session or after a
failure, goes on where the last one ended and every input file reaches the
sink once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema=None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream; the schema defaults to the one of the files now."""
    if schema is None:
        schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith("." + fmt) and not _is_dir(spark, path):
        # a single-file table: watch its folder, filtered to that file name
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory())


def _lasting_root(spark: SparkSession) -> str:
    """The configured checkpoint folder itself: the session's own part of it changes with the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("a run that can be resumed needs root or spark.checkpoint.dir")
    return root


def run_available(stream_df: DataFrame, name: str, root: str | None = None, run_id: str | None = None) -> DataFrame:
    """Process everything available now, append to Parquet, return it as a batch frame.

    Calls with the same ``name``, ``run_id`` and root are one run: a call
    processes the files that no call before it has finished and returns the
    rows of all of them.  Without ``run_id`` each call is a run of its own.
    """
    spark = stream_df.sparkSession
    if run_id is None:
        base, run_id = root or ensure_checkpoint_dir(spark), uuid.uuid4().hex[:12]
    else:
        base = root or _lasting_root(spark)
    run = f"{base.rstrip('/')}/qforge-stream/{name}-{run_id}"
    q = (stream_df.writeStream.format("parquet").outputMode("append")
         .option("path", f"{run}/out").option("checkpointLocation", f"{run}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {q.exception()}")
    return spark.read.schema(stream_df.schema).parquet(f"{run}/out")
