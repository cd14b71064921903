"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: White space that separates words; Python's ``bytes.split()`` uses the same six bytes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and checkpoints usable."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once and bound to a lambda variable.

    Catalyst may copy an aliased expression into every place that uses it;
    a lambda variable is evaluated once per row whatever the plan becomes.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the session's checkpoint folder and reread it.

    Cuts the lineage with files that every executor can see, and lets later
    steps read single columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20,
           max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` at most.

    One longer text is a slice of its own; nothing is dropped.
    """
    for batch in batches:
        start, size, col = 0, 0, batch.column(column)
        lengths = pc.binary_length(col).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def unsigned_unit(hashed: Column) -> Column:
    """A signed 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0 ** -53)
