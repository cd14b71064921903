"""Quoted fields that go over line ends, or never close, in CSV files of many splits.

A line's effect on the quote depends on whether it starts inside one, which a
split cannot know.  Every split therefore reports the outcome of both cases;
the splits of a file are then folded in order.  Only lines with a quote reach
Python, and one row a split is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outcome of a split read as from outside a quote and as from inside one: whether it ends open, and in which of
#: its lines the open quote began (0: before the split).
SPLIT_SCHEMA = "part string, lines long, spans boolean, out_open boolean, out_line long, in_open boolean, in_line long"

_OPENS = re.compile(r'(?:^|(?<=,))"')
_CLOSES = re.compile(r'(?:[^"]++|"")*+"')


def after_line(line: str, inside: bool) -> tuple[bool, bool]:
    """Whether a quote is open after ``line``, and whether that one began in it.

    A quote opens at the start of a field only and closes at the first quote
    that is neither doubled nor escaped; others belong to the text.
    """
    at = 0
    if inside:
        closing = _CLOSES.match(line)
        if closing is None:
            return True, False
        at = closing.end()
    while opening := _OPENS.search(line, at):
        closing = _CLOSES.match(line, opening.end())
        if closing is None:
            return True, True
        at = closing.end()
    return False, False


class _Split:
    def __init__(self):
        self.lines, self.spans = 0, False
        self.open, self.line = [False, True], [0, 0]  # read as from outside, as from inside

    def read(self, texts: pa.Array) -> None:
        places = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        for place, text in zip(places, texts.drop_null().to_pylist()):
            for case in (0, 1):
                self.open[case], here = after_line(text, self.open[case])
                if here:
                    self.line[case] = self.lines + int(place) + 1
            self.spans |= self.open[0]
        self.lines += len(texts)

    def row(self, part: str) -> tuple:
        return part, self.lines, self.spans, self.open[0], self.line[0], self.open[1], self.line[1]


def _split_outcomes(batches):
    names = [c.split()[0] for c in SPLIT_SCHEMA.split(", ")]
    current, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        start = 0
        for part, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if part != current:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in state.row(current)], names=names)
                current, state = part, _Split()
            state.read(batch.column(1).slice(start, end - start))
            start = end
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in state.row(current)], names=names)


@dataclass
class QuoteReport:
    spans: bool                # some quoted field goes over a line end
    file: str | None = None    # first file with a quote that is never closed
    line: int | None = None    # the line, from 1, in which that quote begins


def quote_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ``file, spans, open, line`` (``line``: where the quote still open at the end began)."""
    lines = spark.read.text(path).select(
        F.concat_ws("\n", F.col("_metadata.file_block_start").cast("string"), "_metadata.file_path").alias("part"),
        F.when(F.contains("value", F.lit('"')), F.col("value")).alias("line"))
    splits = lines.mapInArrow(_split_outcomes, SPLIT_SCHEMA).select(
        F.substring_index("part", "\n", -1).alias("file"),
        F.struct(F.substring_index("part", "\n", 1).cast("long").alias("start"), "lines", "spans", "out_open", "out_line",
                 "in_open", "in_line").alias("split"))
    in_order = splits.groupBy("file").agg(F.array_sort(F.collect_list("split")).alias("splits"))
    begin = F.struct(F.lit(False).alias("spans"), F.lit(False).alias("open"), F.lit(0).cast("long").alias("line"),
                     F.lit(0).cast("long").alias("lines"))

    def then(so_far, split):
        line = (F.when(so_far.open & (split.in_line == 0), so_far.line).when(so_far.open, so_far.lines + split.in_line)
                .otherwise(so_far.lines + split.out_line))
        return F.struct((so_far.spans | so_far.open | split.spans).alias("spans"),
                        F.when(so_far.open, split.in_open).otherwise(split.out_open).alias("open"),
                        line.alias("line"), (so_far.lines + split.lines).alias("lines"))

    return in_order.select("file", F.aggregate("splits", begin, then).alias("end")).select(
        "file", "end.spans", "end.open", F.when(F.col("end.open"), F.col("end.line")).alias("line"))


def check_quotes(spark: SparkSession, path: str) -> QuoteReport:
    """Whether quoted fields span lines, and the first quote without an end."""
    first = F.min(F.when(F.col("open"), F.struct("file", "line")))
    found = quote_outcomes(spark, path).agg(F.max("spans").alias("spans"), first.alias("first")).first()
    return QuoteReport(bool(found["spans"]), *(found["first"] or (None, None)))
