"""N-gram Jaccard join with signature trees.

A document is the set of its distinct word shingles (64-bit hashes).  Equal
sets are one vertex, named by 64 bits of hash, so a group of copies of any
size is one set.  Two sets link when ``percent`` of their union is common.

Put in an order that all sets have in common, sets that link also have
neighbours in common: a shingle that only one of two sets has parts at most
two pairs of neighbours of that set and one of the other. If ``broken`` is the
most pairs that can be lost so, one of the first ``broken + 1`` pairs of
neighbours of each set is a first pair of the other. Pairs are hardly ever
shared by chance, as single shingles are in a large corpus. The order puts
shingles that several sets of a slice share last, by how many they are, all
others first by hash: a passage that very many documents hold is then in the
first pairs only of documents that have little else. The counts are taken from
all documents; they make the search faster and cannot change its result. Sets
with a first pair in common are put in the order of their sizes, and a
run breaks where the next size is too large for a link; of equal sizes a
slice passes on one set and joins the others to it before anything is
shuffled. The connected components of these runs are families: every link
lies inside one family.

A family is cut into blocks of bounded size, sets with the same smallest
hash together.  Each block is searched with its family's first block; then
every other pair of blocks whose summaries (bitmap of all shingles, range of
sizes) allow a link and which are not one component yet.  A task builds a
signature tree over its sets: an inner node stands for a few neighbouring
sets or nodes and has the OR of their bitmaps, the range of their sizes and
the largest number of shingles that share a bit with another.  The tree is
traversed against itself: a pair of nodes goes on only if the largest
overlap its bitmaps allow reaches what the smallest sizes need, if the size
ranges are compatible, and if not all below is one component already.  Pairs
of sets that come through are compared exactly.  A task reports for each set
the first set of its component, never all pairs.  Sets are made anew from
the texts where they are needed: a text takes less room than its shingles.

Defined cases: null texts and texts without words have no shingles and link
with nothing (each its own component); a text with fewer words than a
shingle is one shingle; repeated rows are equal sets; a null id never names
a component (null if it has no other id); an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import connected_components

SHINGLE, PERCENT = 4, 85
#: Shingles whose rank by frequency is broadcast (12 bytes each).
FREQUENT = 1 << 20
#: 64-bit words of the table that keeps texts without a candidate out of the shuffle.
FILTER_WORDS = 1 << 20
#: Sets and shingles of one block, on average.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
#: Children of a node, 64-bit words compared at a time, bits of a block's summary.
FAN_OUT, FRONTIER_WORDS, SUMMARY_BITS = 8, 1 << 21, 1 << 14
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles of ``text``, ASCII letters lower-cased."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(shingle, len(w))
    out = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * _MUL + h[i:len(h) - size + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def set_key(s: np.ndarray) -> int:
    key = xxhash.xxh64_intdigest(s.tobytes())
    return key - (1 << 64) if key >> 63 else key


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether ``percent`` of the union of two ascending sets is common."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return common > 0 and (100 + percent) * common >= percent * (len(x) + len(y))


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets = [shingle_set(t, shingle) for t in part.column("t").to_pylist()]
            keys = [set_key(s) for s in sets]
            # shingles that several different sets of the slice hold go into its first row
            value, n = np.unique(np.concatenate(list(dict(zip(keys, sets)).values())), return_counts=True)
            shared, rest = n > 1, [None] * (part.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                 pa.array([int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets], pa.int64()),
                 pa.array([value[shared].view(np.int64)] + rest, pa.list_(pa.int64())),
                 pa.array([n[shared]] + rest, pa.list_(pa.int64()))], ["id", "h", "n", "v", "m", "shared", "times"])
    return run


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, h, n, v, m, shared[], times[])``: hash of the text; size, key and smallest hash of its set; shared shingles of its slice."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(
        _set_rows(shingle), f"id {kind}, h bigint, n bigint, v bigint, m bigint, shared array<bigint>, times array<bigint>")


def frequent_shingles(sets: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` shingles shared by the most sets, ascending, and their rank (the most shared has the highest)."""
    rows = sets.filter("shared IS NOT NULL").select(F.explode(F.arrays_zip("shared", "times")).alias("x"))
    top = rows.groupBy(F.col("x.shared").alias("h")).agg(F.sum("x.times").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    top = top.toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    rank = np.empty(len(h), np.int32)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1, dtype=np.int32)
    order = np.argsort(h)
    return h[order], rank[order]


def first_pairs(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Hashes of the pairs of neighbours of which every linked set shares one; none if only an equal set can link."""
    n = len(s)
    if 100 * n < percent * (n + 1):
        return s[:0]
    known, rank = frequent
    order = np.zeros(n, np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        order = np.where(known[at] == s, rank[at], 0)
    # most shingles that only this set has, and then most that only the other has
    own = (100 - percent) * n // 100
    broken = 2 * own + 100 * (n - own) // percent - n
    first = s[np.lexsort((s, order))[:broken + 2]]
    return (first[:-1] * _MUL + first[1:]) * _MIX


def _first_rows(frequent, shingle: int, percent: int):
    """``(x, n, v)``: first pair, size and set, one set of each size a slice; ``(v, null, v, u)``: sets joined in the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets = {set_key(s): s for s in (shingle_set(t, shingle) for t in part.column("t").to_pylist())}
            found = [first_pairs(s, frequent.value, percent) for s in sets.values()]
            times = [len(f) for f in found]
            x = np.concatenate(found).view(np.int64)
            v = np.repeat(np.fromiter(sets, np.int64, len(sets)), times)
            n = np.repeat(np.array([len(s) for s in sets.values()], np.int64), times)
            order = np.lexsort((v, n, x))
            x, n, v = x[order], n[order], v[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (n[1:] != n[:-1])
            first = np.flatnonzero(new)
            u = v[first][np.cumsum(new) - 1]
            joined = np.unique(np.stack([v, u], 1)[(~new) & (u != v)], axis=0)
            pair = np.arange(len(first) + len(joined)) >= len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[x[first], joined[:, 0]]), pa.array(np.r_[n[first], joined[:, 0]], mask=pair),
                 pa.array(np.r_[v[first], joined[:, 0]]), pa.array(np.r_[v[first], joined[:, 1]], mask=~pair)],
                ["x", "n", "v", "u"])
    return run


def families(docs: DataFrame, sets: DataFrame, text_col: str = "text", shingle: int = SHINGLE,
             percent: int = PERCENT, most: int = FREQUENT) -> DataFrame:
    """``(v, family)`` of the sets that share a first pair with a set of a fitting size."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(sets, most))
    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(
        _first_rows(frequent, shingle, percent), "x bigint, n bigint, v bigint, u bigint")
    order = Window.partitionBy("x").orderBy("n", "v")
    less = F.lag("n").over(order)
    start = F.when(less.isNull() | (100 * less < percent * F.col("n")), F.col("v"))
    # joined to the first set of its run, so a large group has about one edge a set
    run = F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    stars = rows.withColumn("start", start).select(F.col("v").alias("a"), F.coalesce("u", run).alias("b"))
    edges = stars.filter("a <> b")
    return connected_components(edges.distinct()).withColumnRenamed("root", "family")


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of 64-bit words a set; the low bits of a shingle choose its bit."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        flags = np.zeros(bits, bool)
        flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(flags, bitorder="little").view(np.uint64)
    return out


def _sizes_fit(low_a, high_a, low_b, high_b, percent: int):
    return (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)


class SignatureTree:
    """Nodes over ordered sets, level by level; the nodes of level 0 are the sets."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, fan_out: int = FAN_OUT):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << max(6, int(4 * sizes.mean()).bit_length())
        bitmap = _bitmaps(sets, bits)
        extra = sizes - np.bitwise_count(bitmap).sum(1, dtype=np.int64)
        self.levels = [(bitmap, sizes, sizes, extra, None)]
        self.frontier = max(64, FRONTIER_WORDS // (bits // 64))
        while len(extra) > 1:
            bitmap, low, high, extra, _ = self.levels[-1]
            start = np.arange(0, len(low), fan_out)
            below = np.append(start, len(low))
            bitmap, low = np.bitwise_or.reduceat(bitmap, start, axis=0), np.minimum.reduceat(low, start)
            high, extra = np.maximum.reduceat(high, start), np.maximum.reduceat(extra, start)
            self.levels.append((bitmap, low, high, extra, below))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of nodes whether two sets below may link."""
        bitmap, low, high, extra, _ = self.levels[level]
        fit = _sizes_fit(low[a], high[a], low[b], high[b], self.percent)
        a, b = a[fit], b[fit]
        # common shingles have common bits, but for those that share their bit with another
        common = np.bitwise_count(bitmap[a] & bitmap[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b])
        common = np.minimum(common, np.minimum(high[a], high[b]))
        fit[fit] = (100 + self.percent) * common >= self.percent * (low[a] + low[b])
        return fit

    def components(self, label: np.ndarray) -> np.ndarray:
        """For each set the first set of its component; equal labels are one component already."""
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        root = first[at]
        top = len(self.levels) - 1
        # depth first and nodes against themselves first: neighbours are joined before distant nodes are met
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > self.frontier:
                stack.append((level, a[self.frontier:], b[self.frontier:]))
                a, b = a[:self.frontier], b[:self.frontier]
            apart = self._apart(level, a, b, root)
            a, b = a[apart], b[apart]
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if level == 0:
                root = self._join(a, b, root)
            elif len(a):
                x, y = self._children(level, a, b)
                same = x == y
                stack += [(level - 1, x[part], y[part]) for part in ((~same, same) if level > 1 else (~same,)) if part.any()]
        return root

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of each pair of nodes, each once."""
        below = self.levels[level][4]
        na, nb = below[a + 1] - below[a], below[b + 1] - below[b]
        pair = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = below[a[pair]] + k // nb[pair], below[b[pair]] + k % nb[pair]
        return x[x <= y], y[x <= y]

    def _apart(self, level: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
        """For each pair of nodes whether the sets below are more than one component."""
        low = high = root
        for *_, below in self.levels[1:level + 1]:
            low, high = np.minimum.reduceat(low, below[:-1]), np.maximum.reduceat(high, below[:-1])
        return (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])

    def _join(self, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
        up = root.tolist()

        def find(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry and linked(self.sets[x], self.sets[y], self.percent):
                up[max(rx, ry)] = min(rx, ry)
        return np.array([find(v) for v in range(len(up))])


def _search_rows(shingle: int, percent: int):
    """The stars of each run of equal ``task``; rows are ordered by (task, m, v)."""
    def stars(v: list[int], label: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        v = np.array(v, np.int64)
        if len(v) < 2:
            root = np.zeros(len(v), np.int64)
        elif len(v) == 2:
            root = np.array([0, 0 if linked(*sets, percent) else 1])
        else:
            root = SignatureTree(sets, percent).components(np.array(label, np.int64))
        other = root != np.arange(len(v))
        return pa.RecordBatch.from_arrays([pa.array(v[other]), pa.array(v[root[other]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, ([], [], [])
        for part in slices(batches, "t"):
            for own, v, label, text in zip(*(part.column(c).to_pylist() for c in ("task", "v", "label", "t"))):
                if own != task and rows[0]:
                    yield stars(*rows)
                    rows = ([], [], [])
                task = own
                if rows[0] and rows[0][-1] == v:
                    continue  # a copy
                found = shingle_set(text, shingle)
                if set_key(found) == v:  # else only the hash of the text is the same
                    for column, value in zip(rows, (v, label, found)):
                        column.append(value)
        if rows[0]:
            yield stars(*rows)
    return run


def _wanted(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``(h, t)``: the different texts whose hash ``rows(h)`` names, a few others besides.

    A bit table of ``FILTER_WORDS`` words of 64 bits, whatever the number of
    rows, is broadcast to the scan: the join that follows drops what it lets
    through in error. Copies are merged before and after the shuffle, so the
    copies of one text are not all sent to one task.
    """
    word, bit = F.pmod("h", F.lit(FILTER_WORDS)), F.expr(f"shiftleft(1L, cast((h div {FILTER_WORDS}) & 63 as int))")
    marks = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    kept = texts.withColumn("word", word).join(F.broadcast(marks), "word").filter(F.col("bits").bitwiseAND(bit) != 0)
    return kept.groupBy("h").agg(F.collect_set("t").alias("t")).select("h", F.explode("t").alias("t"))


def _searched(texts: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links inside each task of ``rows(task, v, m, label, h)``; ``texts(h, t)``."""
    rows = materialize(rows.select("task", "v", "m", "label", "h"))
    rows = _wanted(texts, rows).join(rows, "h").drop("h")
    return materialize(rows.repartition("task").sortWithinPartitions("task", "m", "v").mapInArrow(
        _search_rows(shingle, percent), "a bigint, b bigint"))


def _blocked(members: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """``members(v, family, m, n, h)`` with ``block`` from 0 and the number of ``blocks`` of the family."""
    load = F.greatest(F.count(F.lit(1)) / block_sets, F.sum("n") / block_shingles)
    spread = members.groupBy("family").agg(F.ceil(load).alias("spread"))
    # sets with one smallest hash stay together while they fit
    near = members.join(spread.filter("spread > 1"), "family").withColumn("near", F.pmod(F.xxhash64("m"), "spread"))
    parts = near.groupBy("family", "near").agg(F.ceil(load).alias("parts"))
    near = near.join(parts, ["family", "near"]).select("family", "v", "near", F.pmod(F.xxhash64("v"), "parts").alias("part"))
    names = near.select("family", "near", "part").distinct()
    count = names.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("near", "part"))).alias("all"))
    places = count.select("family", F.size("all").alias("blocks"), F.posexplode("all").alias("block", "x")).select(
        "family", "blocks", "block", "x.near", "x.part")
    placed = near.join(places, ["family", "near", "part"]).select("family", "v", "blocks", "block")
    return members.join(placed, ["family", "v"], "left").fillna({"blocks": 1, "block": 0})


def _summary_rows(shingle: int):
    """OR of the sets of each run of one block inside a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets = [shingle_set(t, shingle) for t in part.column("t").to_pylist()]
            names = list(zip(part.column("family").to_pylist(), part.column("block").to_pylist()))
            start = [i for i, x in enumerate(names) if i == 0 or x != names[i - 1]]
            bitmap = _bitmaps(sets, SUMMARY_BITS)
            size = np.array([len(s) for s in sets], np.int64)
            extra = np.maximum.reduceat(size - np.bitwise_count(bitmap).sum(1, dtype=np.int64), start)
            words = np.bitwise_or.reduceat(bitmap, start, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([names[i][k] for i in start], t) for k, t in ((0, pa.int64()), (1, pa.int32()))), pa.array(extra),
                 pa.array(list(words), pa.list_(pa.int64()))], ["family", "block", "extra", "words"])
    return run


def _block_pairs(texts: DataFrame, blocks: DataFrame, labels: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(family, x, y)``: blocks other than the first that may hold a link between two components."""
    rows = blocks.filter("blocks > 2 AND block > 0")
    state = rows.join(labels, "v").groupBy("family", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("one"), F.max("label").alias("other"))
    words = _wanted(texts, rows).join(rows.select("h", "family", "block"), "h").drop("h").sortWithinPartitions("family", "block").mapInArrow(
        _summary_rows(shingle), "family bigint, block int, extra bigint, words array<bigint>")
    words = words.select("family", "block", "extra", F.posexplode("words")).groupBy("family", "block", "pos").agg(
        F.max("extra").alias("extra"), F.bit_or("col").alias("word"))
    words = words.groupBy("family", "block").agg(F.max("extra").alias("extra"), F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    nodes = materialize(state.join(words, ["family", "block"]))
    x, y = (nodes.select("family", *[F.col(c).alias(f"{c}_{s}") for c in nodes.columns if c != "family"]) for s in "xy")
    pairs = x.join(y, "family").filter("block_x < block_y AND NOT (one_x = other_x AND one_y = other_y AND one_x = one_y)")
    pairs = pairs.filter(_sizes_fit(F.col("low_x"), F.col("high_x"), F.col("low_y"), F.col("high_y"), percent))
    common = F.aggregate(F.zip_with("words_x", "words_y", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, c: n + c)
    most = F.least(common + F.least("extra_x", "extra_y"), "high_x", "high_y")
    return pairs.filter((100 + percent) * most >= percent * (F.col("low_x") + F.col("low_y"))).select(
        "family", F.col("block_x").alias("x"), F.col("block_y").alias("y"))


def family_links(texts: DataFrame, members: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                 block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(a, b)``: links that connect the sets of ``members(v, family, m, n, h)`` as far as links connect them."""
    blocks = materialize(_blocked(members, block_sets, block_shingles))
    # the first block of a family goes with each of the others
    tasks = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1)))) \
        .otherwise(F.array("block"))
    alone = blocks.withColumn("label", F.col("v")).withColumn("task", F.explode(tasks))
    links = _searched(texts, alone.withColumn("task", F.xxhash64("family", "task")), shingle, percent)
    if blocks.filter("blocks > 2").isEmpty():
        return links
    found = connected_components(links)
    labels = materialize(blocks.select("v").join(found, "v", "left").select("v", F.coalesce("root", "v").alias("label")))
    pairs = materialize(_block_pairs(texts, blocks, labels, shingle, percent))
    wanted = pairs.select(F.xxhash64("family", "x", "y").alias("task"), "family", F.explode(F.array("x", "y")).alias("block"))
    rows = blocks.join(wanted, ["family", "block"]).join(labels, "v")
    return links.unionByName(_searched(texts, rows, shingle, percent))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT, frequent: int = FREQUENT, block_sets: int = BLOCK_SETS,
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(id, n, component)`` per document: size of its set, the smallest id reachable by links; ``percent`` from 70."""
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100: below, small sets that link may have no neighbours in common")
    sets = materialize(shingle_sets(docs, id_col, text_col, shingle))
    family = families(docs, sets, text_col, shingle, percent, frequent)
    # one text stands for all of its set
    members = sets.join(family, "v").groupBy("v", "family").agg(F.min("h").alias("h"), F.min("m").alias("m"), F.min("n").alias("n"))
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    roots = connected_components(family_links(texts, members, shingle, percent, block_sets, block_shingles))
    copies = sets.filter("n > 0").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    copies = copies.join(roots, "v", "left")
    named = copies.groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("least").alias("component"))
    # sets of one document without a link keep its id
    copies = copies.filter("copies > 1 OR root IS NOT NULL").select("v", F.coalesce("root", "v").alias("root"))
    component = materialize(copies.join(named, "root").select("v", "component", F.lit(True).alias("found")))
    return sets.join(component, "v", "left").select(
        "id", "n", F.when(F.col("found"), F.col("component")).otherwise(F.col("id")).alias("component"))
