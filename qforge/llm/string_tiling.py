"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are lower-cased word sequences (``\\w+``).
A document and an item become a candidate pair when they share a seed of
``min_match`` consecutive words (the whole item if it is shorter).  Each pair
is tiled: the longest matches are found by running Karp-Rabin over the words
not yet marked, longest first, marked without overlap, and the search length
is halved until ``min_match``.  A document leaks an item when the tiles cover
at least ``min_coverage`` of the item's words, in any order, so passages
whose sentences were rearranged are caught too.

The benchmark is handled in blocks of at most ``block_bytes`` of text, each
sent to the tasks as a broadcast of that bound; every block is matched
against every whole document.

Defined cases: null and empty texts (documents or items) share no seed and
match nothing; repeated documents each give their own rows, repeated items
too; an empty benchmark or document table gives no pairs; other columns of
the documents are not read (and are all kept by ``decontaminate``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices

MIN_MATCH, MIN_COVERAGE = 5, 0.8
BLOCK_BYTES = 16 << 20

_TOKEN = re.compile(r"\w+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _unmarked(marked: bytearray, length: int) -> Iterator[int]:
    """Starts of windows of ``length`` words without a marked one."""
    run = 0
    for i, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= length:
            yield i - length + 1


def _hashes(seq: list[int], length: int) -> list[int]:
    """Karp-Rabin hash of every window of ``length``."""
    if len(seq) < length:
        return []
    top, h = pow(_BASE, length - 1, _MOD), 0
    for x in seq[:length]:
        h = (h * _BASE + x + 2) % _MOD
    out = [h]
    for gone, x in zip(seq, seq[length:]):
        h = ((h - (gone + 2) * top) * _BASE + x + 2) % _MOD
        out.append(h)
    return out


def _matches(doc, item, done, used, length):
    """Maximal matches of at least ``length`` unmarked words, as (size, doc start, item start)."""
    at: dict[int, list[int]] = {}
    hashed = _hashes(item, length)
    for j in _unmarked(used, length):
        at.setdefault(hashed[j], []).append(j)
    hashed, found = _hashes(doc, length), []
    for i in _unmarked(done, length):
        for j in at.get(hashed[i], ()):
            if i and j and doc[i - 1] == item[j - 1] and not (done[i - 1] or used[j - 1]):
                continue  # part of the longer match that starts before it
            k = 0
            while (i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]
                   and not (done[i + k] or used[j + k])):
                k += 1
            if k >= length:
                found.append((k, i, j))
    return found


def greedy_tiles(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (size, doc start, item start), longest first."""
    done, used, tiles = bytearray(len(doc)), bytearray(len(item)), []
    length = max(min(len(doc), len(item)), min_match)
    while True:
        while found := _matches(doc, item, done, used, length):
            marked = False
            for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
                if any(done[i:i + k]) or any(used[j:j + k]):
                    continue  # its rest, if long enough, is found again
                done[i:i + k] = used[j:j + k] = b"\1" * k
                tiles.append((k, i, j))
                marked = True
            if not marked:
                break
        if length == min_match:
            return tiles
        length = max(length // 2, min_match)


def _index(items: list[tuple], min_match: int) -> tuple:
    """Word ids, items as ids, and seed hash -> items for each seed length."""
    vocab: dict[str, int] = {}
    coded = []
    for key, text in items:
        coded.append((key, [vocab.setdefault(w, len(vocab)) for w in tokens(text)]))
    seeds: dict[int, dict[int, set[int]]] = {}
    for n, (_, seq) in enumerate(coded):
        size = min(min_match, len(seq))
        if size:
            table = seeds.setdefault(size, {})
            for h in _window_hashes(np.array(seq, np.int64), size).tolist():
                table.setdefault(h, set()).add(n)
    arrays = {size: np.sort(np.array(list(t), np.uint64)) for size, t in seeds.items()}
    return vocab, coded, seeds, arrays


def _window_hashes(seq: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hash of the windows of ``size`` ids (seeds only; tiles compare words)."""
    n = len(seq) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (seq[k:k + n] + 2).astype(np.uint64)
    return h


def tile_document(text: str | None, index: tuple, min_match: int) -> Iterator[tuple]:
    """(item number, tiles, covered words, item words) for every item that shares a seed."""
    vocab, coded, seeds, arrays = index
    get = vocab.get
    seq = np.array([get(w, -1) for w in tokens(text)], np.int64)
    spans: dict[int, list[int]] = {}
    for size, known in arrays.items():
        h = _window_hashes(seq, size)
        if not len(h):
            continue
        pos = np.minimum(np.searchsorted(known, h), len(known) - 1)
        for i in np.flatnonzero(known[pos] == h).tolist():
            for n in seeds[size][int(h[i])]:
                spans.setdefault(n, []).append(i)
    for n, starts in spans.items():
        item, size = coded[n][1], min(min_match, len(coded[n][1]))
        near = np.zeros(len(seq), bool)
        for i in starts:
            near[i:i + size] = True
        # tiles consist of seeds: keep those runs, parted by ids that no item has
        runs = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8))).reshape(-1, 2)
        doc = [x for a, b in runs for x in (*seq[a:b].tolist(), -1)]
        tiles = greedy_tiles(doc, item, size)
        yield n, len(tiles), sum(t[0] for t in tiles), len(item)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str,
                     block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items as lists whose texts hold about ``block_bytes`` each."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    total, rows = benchmark.agg(F.sum(size), F.count(F.lit(1))).first()
    blocks = max(1, -(-2 * (total or 0) // block_bytes)) if (total or 0) > block_bytes else 1
    if not rows:
        return
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))
    for b in range(blocks):
        items = benchmark.filter(block == b).select(id_col, text_col).collect()
        yield [(r[0], r[1]) for r in items]


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH,
                 min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, item, n_tiles, covered, item_words, coverage)`` of the pairs that leak."""
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, n_tiles bigint, covered bigint, item_words bigint, coverage double"
    out = spark.createDataFrame([], schema)
    arrow = to_arrow_schema(out.schema)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(_index(items, min_match))
        out = out.unionByName(rows.mapInArrow(_pair_rows(sent, arrow, min_match, min_coverage), schema))
    return out


def _pair_rows(sent, arrow: pa.Schema, min_match: int, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in slices(batches, "t"):
            rows = [(key, index[1][n][0], tiles, covered, size, covered / size)
                    for key, text in zip(part.column("id").to_pylist(), part.column("t").to_pylist())
                    for n, tiles, covered, size in tile_document(text, index, min_match)
                    if covered >= min_coverage * size]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", min_match: int = MIN_MATCH,
                  min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns unchanged and without a shuffle."""
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_index(items, min_match))
        docs = docs.filter(~_leak_test(sent, min_match, min_coverage)(F.col(text_col)))
    return docs


def _leak_test(sent, min_match: int, min_coverage: float):
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        return pa.array([any(covered >= min_coverage * size for _, _, covered, size
                             in tile_document(t, sent.value, min_match)) for t in texts.to_pylist()], pa.bool_())
    return leaks
