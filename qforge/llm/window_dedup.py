"""Removal of word windows that occur more than once, by level-wise doubling.

Level one looks at windows of half the length (``(window + 1) // 2`` words).
Of these only the content-defined minima go into the shuffle: a short window
whose hash is the smallest of some full window that holds it.  Equal full
windows have equal minima, so none is missed.  Full windows around a short
window that occurs at two places are the candidates of level two, where they
are compared by 128 bits of hash; ``longest_repeats`` goes on doubling from
there until no candidate survives.

Texts that are equal as a whole are one content with a count: all windows of
a content with two or more copies repeat, and a copy is no evidence of its
own on any level, so hot groups of copies add nothing to the shuffles.
Counting is a partial aggregation of (hash, smallest place, largest place),
and the join that brings the verdict back is an equi-join that adaptive
execution splits for passages that very many documents share.

Defined cases: null and empty texts and texts shorter than the window keep
all their words; a text that overlaps its own repetition loses both places;
repeated rows and ids are copies like any other; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

WINDOW = 35
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _windows(hashes: np.ndarray, size: int, mul: int = _MUL[0]) -> np.ndarray:
    """Mixed polynomial hash of every window of ``size`` words."""
    n = max(len(hashes) - size + 1, 0)
    out, mul = np.zeros(n, np.uint64), np.uint64(mul)
    for k in range(size if n else 0):
        out = out * mul + hashes[k:k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _sliding(a: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        a = pick(a[:-have], a[have:])
        have *= 2
    return a if have == size else pick(a[:len(a) - (size - have)], a[size - have:])


def seeds(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the short windows that are the minimum of a full window."""
    short = (window + 1) // 2
    span = window - short + 1
    g = _windows(hashes, short)
    if len(g) < span:
        return g[:0], np.zeros(0, np.int32)
    low = _sliding(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), span, np.maximum) == g)
    return g[at], at.astype(np.int32)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            found = [seeds(_word_hashes(_words(t)), window) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"), _lists([f[0] for f in found], pa.int64()),
                 _lists([f[1] for f in found], pa.int32())], ["k1", "k2", "h", "at"])
    return run


def _candidate_rows(window: int):
    """128-bit hashes of the full windows around the surviving short windows."""
    short = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            starts, first, second = [], [], []
            for text, at in zip(part.column("t").to_pylist(), part.column("at")):
                hashes = _word_hashes(_words(text))
                near = np.zeros(len(hashes) + 1, np.int32)
                p = at.values.to_numpy().astype(np.int64)
                np.add.at(near, np.maximum(p - (window - short), 0), 1)
                np.add.at(near, p + 1, -1)
                s = np.flatnonzero(np.cumsum(near)[:max(len(hashes) - window + 1, 0)])
                starts.append(s.astype(np.int32))
                first.append(_windows(hashes, window, _MUL[0])[s])
                second.append(_windows(hashes, window, _MUL[1])[s])
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"), _lists(first, pa.int64()), _lists(second, pa.int64()),
                 _lists(starts, pa.int32())], ["k1", "k2", "h", "g", "at"])
    return run


def _keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows ``(k1, k2, at, *names)`` whose names occur at two places, as ``(k1, k2, at[])``."""
    place = F.xxhash64("k1", "k2", "at")
    # written, so that both sides of the join are plain exchanges and a hot name can be split
    twice = materialize(rows.groupBy(*names).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
                        .filter("lo <> hi").select(*names))
    return rows.join(twice, names).groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))


def _contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), *_keys(F.col(text_col)), F.col(text_col).alias("t"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(k1, k2, copies, at)`` of contents with a repeated window, and the candidates of level two.

    ``at``: starts of repeated full windows (null: only the whole text repeats).
    """
    texts = _contents(docs, id_col, text_col)
    copies = materialize(texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep")))
    level = materialize(texts.select("k1", "k2", "t").mapInArrow(
        _seed_rows(window), "k1 bigint, k2 bigint, h array<bigint>, at array<int>"))
    level = level.select("k1", "k2", F.explode(F.arrays_zip("h", "at")).alias("x")).select("k1", "k2", "x.h", "x.at")
    alive = _repeated(level, ["h"]).join(copies.select("k1", "k2", "rep"), ["k1", "k2"])
    # one row stands for all copies of a content
    chosen = texts.join(materialize(alive), ["k1", "k2"]).filter(F.col("id").eqNullSafe(F.col("rep")))
    level = materialize(chosen.select("k1", "k2", "t", "at").mapInArrow(
        _candidate_rows(window), "k1 bigint, k2 bigint, h array<bigint>, g array<bigint>, at array<int>"))
    level = level.select("k1", "k2", F.explode(F.arrays_zip("h", "g", "at")).alias("x")).select(
        "k1", "k2", "x.h", "x.g", "x.at")
    spans = _repeated(level, ["h", "g"])
    many = copies.filter("copies > 1").select("k1", "k2", "copies")
    return materialize(spans.join(many, ["k1", "k2"], "full")), level


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """``(k1, k2, longest)``: the largest ``window * 2**i`` words repeated at two places of the corpus' contents.

    A window of twice the length can only repeat if both its halves do, and
    is named by the names of its halves; levels go on while any survives.
    """
    _, level = repeated_windows(docs, id_col, text_col, window)
    level, size, out = level.distinct(), window, None
    while True:
        place = F.xxhash64("k1", "k2", "at")
        twice = level.groupBy("h", "g").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi")
        level = materialize(level.join(twice.select("h", "g"), ["h", "g"]))
        if level.isEmpty():
            return out if out is not None else level.select("k1", "k2", F.lit(0).alias("longest"))
        found = level.select("k1", "k2", F.lit(size).alias("longest")).distinct()
        out = found if out is None else out.unionByName(found).groupBy("k1", "k2").agg(F.max("longest").alias("longest"))
        right = level.select("k1", "k2", (F.col("at") - size).alias("at"), F.col("h").alias("h2"), F.col("g").alias("g2"))
        level = level.join(right, ["k1", "k2", "at"]).select(
            "k1", "k2", "at", F.xxhash64("h", "h2").alias("h"), F.xxhash64("g2", "g").alias("g"))
        size *= 2


def _kept_rows(window: int, names: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            rows = [[], [], []]
            for text, copies, at in zip(part.column("t").to_pylist(), part.column("copies").to_pylist(), part.column("at")):
                w = _words(text)
                if len(w) < window:
                    kept = w
                elif copies:
                    kept = []
                elif not at.is_valid:
                    kept = w
                else:
                    edge = np.zeros(len(w) + 1, np.int64)
                    starts = at.values.to_numpy()
                    edge[starts] += 1
                    np.add.at(edge, starts + window, -1)
                    kept = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                rows[0].append(len(w))
                rows[1].append(len(w) - len(kept))
                joined = b" ".join(kept)
                rows[2].append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, rows[:2]), pa.array(rows[2], pa.string())],
                                             names=names)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   digest: bool = False) -> DataFrame:
    """Per document: id, n_words, n_removed and the kept words (or their SHA-256)."""
    spans, _ = repeated_windows(docs, id_col, text_col, window)
    name = "kept_sha256" if digest else "kept_text"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _contents(docs, id_col, text_col).join(spans, ["k1", "k2"], "left").select("id", "t", "copies", "at")
    return rows.mapInArrow(_kept_rows(window, ["id", "n_words", "n_removed", name], digest),
                           f"id {kind}, n_words bigint, n_removed bigint, {name} string").withColumnRenamed("id", id_col)
