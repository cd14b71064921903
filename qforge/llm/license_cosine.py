"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Every window of a text that has a template's length is compared with the
template by the cosine of their TF-IDF vectors; the best template at or above
``min_cosine`` is the file's own licence.  Only windows near a template's
anchor terms are computed: without any of them the cosine cannot reach the
threshold (Cauchy-Schwarz), so nothing is missed and whole texts are covered.
Document frequencies of all terms are counted over all files.  A scan first
keeps the windows that would reach the threshold if their other terms were in
every file; a join with the frequencies of those terms then gives the cosine.

A file without an own licence takes the one of its nearest ancestor directory
(its own directory first) that holds a licence file: directories are paired
with all their ancestors, joined with the licensed directories by path, and
the deepest match is kept, once per directory; files then join theirs.

Defined cases: null and empty texts have no licence of their own; a null path
has no directory and inherits nothing; several licence files in one directory
resolve to the highest cosine, then the smaller name; repeated rows are
scanned one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Short notices by licence name (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
}
MIN_COSINE = 0.85
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"

_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


class TemplateIndex:
    """Unit TF-IDF vectors of the templates and their anchor terms."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], files: int, min_cosine: float):
        self.min_cosine, self.files = min_cosine, files
        self.idf = {t: math.log((files + 1) / (frequency.get(t, 0) + 1)) + 1 for x in templates.values() for t in terms(x)}
        self.rare = math.log(files + 1) + 1  # idf of a term that no file has
        self.vectors, self.length, self.anchors = {}, {}, {}
        for name in sorted(templates):
            seq = terms(templates[name])
            raw = {t: n * self.idf[t] for t, n in Counter(seq).items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors[name], self.length[name] = {t: v / norm for t, v in raw.items()}, len(seq)
            left, chosen = 1.0, set()
            for t, v in sorted(self.vectors[name].items(), key=lambda x: (-x[1], x[0])):
                if math.sqrt(max(left, 0.0)) < min_cosine:
                    break
                chosen.add(t)
                left -= v * v
            for t in chosen:
                self.anchors.setdefault(t, []).append(name)

    def windows(self, text: str | None) -> Iterator[tuple[str, Counter]]:
        """Template name and term counts of every window near an anchor of the template."""
        seq = terms(text)
        near: dict[str, set[int]] = {}
        for i, t in enumerate(seq):
            for name in self.anchors.get(t, ()):
                n = self.length[name]
                near.setdefault(name, set()).update(range(max(0, i - n + 1), min(i, max(len(seq) - n, 0)) + 1))
        for name in sorted(near):
            for start in sorted(near[name]):
                yield name, Counter(seq[start:start + self.length[name]])

    def parts(self, name: str, tf: Counter) -> tuple[float, float, dict[str, int]]:
        """Product with the template, squared norm of the template terms, counts of the other terms."""
        vector = self.vectors[name]
        own = {t: k * self.idf[t] for t, k in tf.items() if t in self.idf}
        return (sum(vector.get(t, 0.0) * v for t, v in own.items()), sum(v * v for v in own.values()),
                {t: k for t, k in tf.items() if t not in self.idf})

    def best(self, text: str | None) -> tuple[str | None, float]:
        """Best template if no file had the other terms."""
        found = (None, 0.0)
        for name, tf in self.windows(text):
            dot, own, other = self.parts(name, tf)
            cosine = dot / math.sqrt(own + sum((k * self.rare) ** 2 for k in other.values()))
            if cosine >= self.min_cosine and cosine > found[1] + 1e-12:
                found = (name, min(cosine, 1.0))
        return found

    def candidates(self, text: str | None) -> list[dict]:
        """Distinct windows that reach the threshold if every file has the other terms (idf 1, the least)."""
        found = {}
        for name, tf in self.windows(text):
            dot, own, other = self.parts(name, tf)
            if dot >= (self.min_cosine - 1e-9) * math.sqrt(own + sum(k * k for k in other.values())):
                found[name, dot, own, frozenset(other.items())] = None
        return [{"name": n, "dot": d, "own": o, "other": [{"term": t, "k": k} for t, k in sorted(x)]} for n, d, o, x in found]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the files that have each term."""
    counts: Counter = Counter()

    def flush(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "n"])

    for part in slices(batches, "t"):
        for t in part.column("t").to_pylist():
            counts.update(set(terms(t)))
            if len(counts) > 300_000:
                yield flush(counts)
                counts = Counter()
    yield flush(counts)


_WINDOWS = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("own", pa.float64()),
                               ("other", pa.list_(pa.struct([("term", pa.string()), ("k", pa.int64())])))]))


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = sent.value, TaskContext.get().partitionId() << 40
        for part in slices(batches, "t"):
            found = [index.candidates(t) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("path"), pa.array(range(number, number + len(found)), pa.int64()),
                 pa.array(found, _WINDOWS)], ["id", "path", "row", "windows"])
            number += len(found)
    return run


def _best_windows(scanned: DataFrame, frequency: DataFrame, files: int, min_cosine: float) -> DataFrame:
    """``(row, own, cosine)`` of the rows with a window at or above ``min_cosine``."""
    windows = scanned.select("row", F.posexplode("windows").alias("at", "x")).select("row", "at", "x.*")
    other = windows.select("row", "at", F.explode("other").alias("x")).select("row", "at", "x.term", "x.k")
    idf = F.log((F.lit(files) + 1) / (F.col("n") + 1)) + 1
    other = other.join(frequency, "term").groupBy("row", "at").agg(F.sum((F.col("k") * idf) ** 2).alias("rest"))
    cosine = F.col("dot") / F.sqrt(F.col("own") + F.coalesce("rest", F.lit(0.0)))
    found = windows.drop("other").join(other, ["row", "at"], "left").withColumn("cosine", cosine).filter(F.col("cosine") >= min_cosine)
    first = F.min(F.struct((-F.round("cosine", 12)).alias("down"), "name", F.least("cosine", F.lit(1.0)).alias("cosine")))
    return found.groupBy("row").agg(first.alias("x")).select("row", F.col("x.name").alias("own"), "x.cosine")


def _directory(path: Column) -> Column:
    """The folder of a path, the empty string for the root; a null path has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  templates: dict[str, str] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Per file: id, path, license, cosine, origin (header, inherited, none) and the directory it came from."""
    spark = files.sparkSession
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("t"))
    vocabulary = sorted({t for x in templates.values() for t in terms(x)})
    frequency = materialize(rows.select("t").mapInArrow(_document_frequency, "term string, n bigint")
                            .groupBy("term").agg(F.sum("n").alias("n")))
    counts = frequency.filter(F.col("term").isin(vocabulary)).collect()
    n_files = files.count()
    index = TemplateIndex(templates, {r[0]: r[1] for r in counts}, n_files, min_cosine)
    kind = files.schema[id_col].dataType.simpleString()
    scanned = materialize(rows.mapInArrow(
        _scan(spark.sparkContext.broadcast(index)), f"id {kind}, path string, row bigint, "
        "windows array<struct<name:string,dot:double,own:double,other:array<struct<term:string,k:bigint>>>>"))
    best = _best_windows(scanned, frequency, n_files, min_cosine)
    scanned = materialize(scanned.drop("windows").join(best, "row", "left").drop("row").withColumn("dir", _directory(F.col("path"))))
    licensed = scanned.filter(F.regexp_replace("path", "^.*/", "").rlike(LICENSE_FILE) & F.col("own").isNotNull())
    licensed = licensed.groupBy("dir").agg(F.max_by("own", F.struct("cosine", "own")).alias("inherited"))
    # each directory with itself and all its ancestors, the deepest licensed one wins
    parts = F.split("dir", "/")
    above = scanned.filter(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct().select(
        F.col("dir").alias("below"), F.explode(F.concat(F.array(F.lit("")), F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("dir")).distinct()
    nearest = above.join(licensed, "dir").groupBy("below").agg(
        F.max_by(F.struct("inherited", "dir"), F.length("dir")).alias("from"))
    nearest = materialize(nearest.select(F.col("below").alias("dir"), F.col("from.inherited"), F.col("from.dir").alias("license_dir")))
    out = scanned.join(nearest, "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("own", "inherited").alias("license"),
        F.when(own, F.col("cosine")).alias("cosine"),
        F.when(own, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"))


def derived_path(doc_id: Column) -> Column:
    """A repository path for a document: three directory levels by id.

    Every 16th, 256th and 4096th id is the licence file of a directory of
    the third, second and first level.
    """
    part = lambda letter, n: F.concat(F.lit(letter), F.floor(doc_id / n).cast("long").cast("string"))
    a, b, c = part("a", 4096), part("b", 256), part("c", 16)
    return (F.when(doc_id % 4096 == 0, F.concat_ws("/", a, F.lit("LICENSE")))
            .when(doc_id % 256 == 0, F.concat_ws("/", a, b, F.lit("LICENSE")))
            .when(doc_id % 16 == 0, F.concat_ws("/", a, b, c, F.lit("LICENSE")))
            .when(doc_id.isNotNull(), F.concat_ws("/", a, b, c, F.concat(F.lit("f"), doc_id.cast("string"), F.lit(".txt")))))
