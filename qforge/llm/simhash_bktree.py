"""SimHash near-duplicates found with BK-trees.

Fingerprints follow the contract of ``fingerprints``; two of them link when
at most ``radius`` bits differ.  Equal fingerprints are merged first (partial
aggregation), so groups of exact copies of any size are one vertex.

The trees are sharded by pigeonhole: two 64-bit values that differ in at most
``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so one
BK-tree per (block, value of the block) sees every link.  A shard with more
than ``hot`` members is split once more by the blocks of its other bits.
Each task builds the trees of its shards level by level (children keyed by
the integer Hamming distance to the parent) and searches them following only
the edges within the radius.  A tree over all documents would have to be
broadcast whole, which has no size bound; shard trees stay in the task that
owns the shard.  A task reports, for each member, the smallest member it is
connected to inside the shard (never all pairs); connected components join
these stars.

Defined cases: null and empty texts have fingerprint zero; repeated rows and
ids share a fingerprint and a component; a null id never names a component
(null if its component has no other id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, slices
from .components import connected_components

#: Members from which a shard is split by further blocks.
HOT_SHARD = 2000
#: Members that one task holds and (query, node) pairs it follows at a time.
CHUNK, FRONTIER = 400_000, 2_000_000


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint: bits set in over half the shingle hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``(id, fp)``: one row per document, ``fp`` as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            fp = np.array([simhash(t, shingle) for t in part.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, fp bigint")


def _block_values(fp: Column, start: int, width: int, blocks: int) -> list[Column]:
    """Values of ``blocks`` even bit blocks of ``width`` bits from ``start``."""
    edges = [start + width * i // blocks for i in range(blocks + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
            for a, b in zip(edges, edges[1:])]


def _sharded(fps: DataFrame, radius: int, hot: int) -> DataFrame:
    """``(shard, fp)``: every fingerprint under each of its block values."""
    n = radius + 1
    rows = fps.select("fp", F.posexplode(F.array(*_block_values(F.col("fp"), 0, 64, n))).alias("b", "k"))
    heavy = rows.groupBy("b", "k").count().filter(F.col("count") > hot).select("b", "k", F.lit(True).alias("hot"))
    rows = rows.join(heavy, ["b", "k"], "left")
    # a rotation brings the block's own bits to the top; the others are split again
    edges = [64 * i // n for i in range(n + 1)]
    own = [b - a for a, b in zip(edges, edges[1:])]
    inner = None
    for i in range(n):
        turned = F.col("fp") if edges[i + 1] == 64 else F.shiftrightunsigned(
            F.col("fp"), edges[i + 1]).bitwiseOR(F.shiftleft(F.col("fp"), 64 - edges[i + 1]))
        subs = F.array(*[F.xxhash64(F.col("b"), F.col("k"), F.lit(j), v)
                         for j, v in enumerate(_block_values(turned, 0, 64 - own[i], n))])
        inner = (F.when if inner is None else inner.when)(F.col("b") == i, subs)
    shard = F.when(F.col("hot"), inner).otherwise(F.array(F.xxhash64("b", "k")))
    return rows.select(F.explode(shard).alias("shard"), "fp")


def _popcount(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """One BK-tree per run of equal ``group`` values; every element is a node."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[starts, n])
        self.root = np.repeat(starts, self.sizes)
        active, sub = np.arange(n), self.root.copy()
        keys, nodes = [], []
        while len(active):
            first = np.r_[True, sub[1:] != sub[:-1]]
            parent = active[first][np.cumsum(first) - 1][~first]
            active = active[~first]
            sub = parent * 65 + _popcount(fp[active], fp[parent])
            order = np.argsort(sub, kind="stable")
            active, sub = active[order], sub[order]
            if len(active):
                child = np.r_[True, sub[1:] != sub[:-1]]
                keys.append(sub[child])
                nodes.append(active[child])
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.node = key[order], (np.concatenate(nodes) if nodes else key)[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, element of its tree within ``radius``), level by level."""
        q, at = queries, self.root[queries]
        while len(q):
            d = _popcount(self.fp[q], self.fp[at])
            hit = (d <= radius) & (at < q)
            yield q[hit], at[hit]
            lo = np.searchsorted(self.key, at * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.key, at * 65 + np.minimum(d + radius, 64), "right") - lo
            q = np.repeat(q, count)
            step = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            at = self.node[np.repeat(lo, count) + step]

    def local_roots(self, radius: int) -> np.ndarray:
        """For each element the first element of its component in its tree."""
        label = np.arange(len(self.fp))
        cost = np.cumsum(np.repeat(self.sizes, self.sizes))
        for block in np.split(np.arange(len(label)), np.searchsorted(
                cost, np.arange(FRONTIER, cost[-1] if len(cost) else 0, FRONTIER))):
            for a, b in self.search(block, radius):
                while len(a):
                    ra, rb = label[a], label[b]
                    apart = ra != rb
                    a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                    np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
                    while not np.array_equal(label, up := label[label]):
                        label = up
        return label


def _links(radius: int):
    def emit(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp.view(np.uint64)
        root = BKForest(shard, value).local_roots(radius)
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[root[other]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column("shard").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            if len(shard) >= CHUNK and shard[0] != shard[-1]:
                cut = int(np.flatnonzero(shard != shard[-1])[-1]) + 1
                yield emit(shard[:cut], fp[:cut])
                shard, fp = shard[cut:], fp[cut:]
        if len(shard):
            yield emit(shard, fp)
    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, radius: int = 2, hot: int = HOT_SHARD) -> DataFrame:
    """``(id, fp, component)`` per document; ``component`` the smallest id reachable."""
    return _components(materialize(fingerprints(docs, id_col, text_col, shingle)), radius, hot) \
        .select("id", "fp", "component")


def _components(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """``prints`` with the ``component`` of its fingerprint and ``root``, a fingerprint that tells components apart."""
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    shards = _sharded(fps.select("fp"), radius, hot)
    links = materialize(shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(
        _links(radius), "a bigint, b bigint"))
    roots = connected_components(links)
    linked = fps.join(roots.withColumnRenamed("v", "fp"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    comp = linked.join(named, "root").select("fp", "root", "component")
    # fingerprints without a link are their own component
    comp = fps.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"),
                                               F.coalesce("component", "least").alias("component"))
    return prints.join(comp, "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component that has an id: the smallest id, of its texts the smallest fingerprint.

    Rows are told apart by id and text, so a row goes only if it is linked to
    the one kept: rows that share an id but are not linked stay, and rows with
    a null id stay unless their component has a document with an id.
    """
    h = F.xxhash64(text_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), h.alias("h")).alias("key"), F.col(text_col).alias("text"))
    prints = fingerprints(keyed, "key", "text", shingle).select("id.*", "fp")
    comp = materialize(_components(materialize(prints), radius, HOT_SHARD).filter(F.col("component").isNotNull()))
    least = F.col("id").eqNullSafe(F.col("component"))
    twice = materialize(comp.filter(least).groupBy("id", "root").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "h")).alias("kept")).filter("n > 1").select("id", "root", "kept.h"))
    gone = comp.filter(~least).select("id", "h")
    repeated = not twice.isEmpty()
    if repeated:
        other = twice.withColumnRenamed("h", "kept")
        gone = gone.unionByName(comp.filter(least).join(other, ["id", "root"]).filter("h != kept").select("id", "h"))
    own, gone_id, gone_h = free_names(docs, "h", "gone", "gone_h")
    gone = materialize(gone.distinct().select(F.col("id").alias(gone_id), F.col("h").alias(gone_h)))
    kept = docs.withColumn(own, h)
    kept = kept.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_h)), "left_anti")
    if not repeated:
        return kept.drop(own)
    twice = twice.select(F.col("id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    same = (F.col(id_col) == F.col(gone_id)) & (F.col(own) == F.col(gone_h))
    once = kept.join(twice, same, "left_anti")
    again = kept.join(twice, same, "left_semi").dropDuplicates([id_col, own])
    return once.unionByName(again).drop(own)
