"""Sources and sinks.

Reads go through ``spark.read`` so Parquet gets predicate pushdown and
column pruning; CSV/JSON accept an explicit schema to skip the inference
pass on large inputs.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_quotes import check_quotes

CORRUPT_COL = "_corrupt_record"
#: A quote inside a quoted field is doubled, in files read and written.
CSV_OPTIONS = {"header": "true", "escape": '"'}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """Read a CSV (header, inferred types), JSON or Parquet table."""
    fmt = fmt or _format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.options(**CSV_OPTIONS).csv(path)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    return reader.parquet(path)


def _format_of(path: str) -> str:
    p = path.rstrip("/").lower()
    for ext in ("csv", "json", "parquet"):
        if p.endswith("." + ext):
            return ext
    return "parquet"


@dataclass
class Validation:
    ok: bool
    error: str | None
    df: DataFrame | None


def validate_table(spark: SparkSession, path: str,
                   schema: T.StructType | None = None) -> Validation:
    """The CSV checks in the reference's order.

    zero bytes -> "File is empty"; no data rows -> "CSV contains no data
    rows"; fewer than 2 columns -> "CSV must have at least 2 columns";
    malformed rows -> "Failed to parse CSV: ...".  Without a schema the types
    are inferred first; then a row with more fields than the header is
    malformed, and one with fewer is filled with nulls.  A quote that is never
    closed is malformed; quoted fields may go over line ends.
    """
    size = _path_size(spark, path)
    if size == 0:
        return Validation(False, "File is empty", None)
    try:
        quotes = check_quotes(spark, path)
        if quotes.file is not None:
            return Validation(False, f"Failed to parse CSV: quote opened in line {quotes.line} is never closed ({quotes.file})", None)
        # files with a field over several lines cannot be split
        reader = spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE").option("multiLine", quotes.spans)
        fields = (schema or reader.option("inferSchema", True).csv(path).schema).fields
        with_corrupt = T.StructType(list(fields) + [T.StructField(CORRUPT_COL, T.StringType())])
        df = reader.schema(with_corrupt).option("columnNameOfCorruptRecord", CORRUPT_COL).csv(path)
        data_cols = [f.name for f in fields]
        if len(data_cols) == 0:
            return Validation(False, "File is empty", None)
        if df.isEmpty():
            return Validation(False, "CSV contains no data rows", None)
        if len(data_cols) < 2:
            return Validation(False, "CSV must have at least 2 columns", None)
        malformed = F.col(CORRUPT_COL).isNotNull()
        if schema is None:
            # one more field than the header has, if the row goes that far
            wider = ", ".join(f"c{i} string" for i in range(len(fields) + 1))
            malformed &= F.from_csv(F.col(CORRUPT_COL), wider, CSV_OPTIONS)[f"c{len(fields)}"].isNotNull()
        bad = df.filter(malformed).select(CORRUPT_COL, *data_cols).limit(1).collect()
        if bad:
            return Validation(False, f"Failed to parse CSV: malformed row {bad[0][CORRUPT_COL]!r}", None)
        return Validation(True, None, df.drop(CORRUPT_COL))
    except Exception as exc:  # parse errors surface as analysis/runtime errors
        return Validation(False, f"Failed to parse CSV: {exc}", None)


def _path_size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    return int(fs.getContentSummary(hpath).getLength())


def read_json_records(spark: SparkSession, path: str, schema=None, lines: bool = False) -> DataFrame:
    """S3: a JSON array of objects (``lines=False``) or JSON lines as a frame."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_json_columns(df: DataFrame, json_col: str, key_col: str | None = None) -> DataFrame:
    """Column-oriented JSON ``{col: {idx: val}}`` to a frame.

    Each input row holds one such document; output rows are keyed by
    ``(doc, idx)`` with one string column per JSON column.  The pivot
    values are discovered from the data (a distinct over column names,
    which is metadata-sized).
    """
    doc = F.col(key_col) if key_col else F.lit(0)
    parsed = df.select(doc.alias("_doc"), F.from_json(
        F.col(json_col), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    ).alias("_m"))
    cells = (parsed.select("_doc", F.explode("_m").alias("_col", "_vals"))
             .select("_doc", "_col", F.explode("_vals").alias("_idx", "_val")))
    names = [r[0] for r in cells.select("_col").distinct().orderBy("_col").collect()]
    out = (cells.groupBy("_doc", "_idx").pivot("_col", names).agg(F.first("_val")))
    if key_col is None:
        out = out.drop("_doc")
    return out


def sample_head(df: DataFrame, n: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows under an explicit order (Spark rows have none)."""
    cols = order_by or df.columns
    return df.orderBy(*cols).limit(n)


def describe_schema(df: DataFrame) -> tuple[list[str], dict[str, str], int]:
    """(columns, dtype map, row count); rejects None or 0-column frames."""
    if df is None or len(df.columns) == 0:
        raise ValueError("DataFrame is empty or None")
    return list(df.columns), dict(df.dtypes), df.count()


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records with ISO-8601 timestamps."""
    (df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS")
     .option("dateFormat", "yyyy-MM-dd").json(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, no index column; quotes inside a field are doubled."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def export_metrics_csv(metrics: DataFrame, path: str) -> None:
    """One row per observation (metric_name, value)."""
    write_csv(metrics.select(F.col("metric").alias("metric_name"), "value"), path)


def export_metrics_json(summary, path: str, spark: SparkSession | None = None) -> None:
    """The nested performance summary as JSON text.

    ``summary`` is either a dict document (``runs.performance_summary_doc``,
    written as one JSON line) or a frame (one JSON document per row)."""
    import json
    if isinstance(summary, dict):
        spark = spark or SparkSession.getActiveSession()
        doc = json.dumps(summary, indent=None, default=str)
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    (summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


# -- S13: keyed datasets in the catalog ------------------------------------

def _dataset_table(dataset_id: str) -> str:
    safe = "".join(ch if ch.isalnum() else "_" for ch in dataset_id)
    return f"qforge_ds_{safe}"


def register_dataset(df: DataFrame, dataset_id: str) -> str:
    name = _dataset_table(dataset_id)
    df.write.mode("overwrite").saveAsTable(name)
    return name


def get_dataset(spark: SparkSession, dataset_id: str) -> DataFrame | None:
    name = _dataset_table(dataset_id)
    if not spark.catalog.tableExists(name):
        return None
    return spark.table(name)


def drop_dataset(spark: SparkSession, dataset_id: str) -> bool:
    name = _dataset_table(dataset_id)
    existed = spark.catalog.tableExists(name)
    if existed:
        spark.sql(f"DROP TABLE {name}")
    return existed


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def join_path(*parts: str) -> str:
    return os.path.join(*parts)
