"""Shards of near-equal bytes by a minimax contiguous partition.

Documents with equal text are one atomic group; groups are ordered by the
64-bit hash of their text and cut into contiguous shards so that the largest
shard is as small as possible: a binary search over the capacity, each
capacity checked greedily (fill a shard until the next group would not fit).

The greedy check reads prefix sums of the ordered groups.  The driver holds
them at hash-range boundaries only: first ``2**16`` ranges, then, for the
ranges in which a cut of some still possible capacity may fall, ``2**8``
sub-ranges each, until those ranges are single groups.  Each refinement is
one aggregation of the group table; the table itself is never collected.

Slots number the documents of a shard without gaps: rows are dealt by a hash
of id and text into buckets, numbered inside the bucket, and offset by the
counts of the shard's earlier buckets.  No task gets a whole shard or group.

Defined cases: a null text counts as the empty text (size 1, in one group
with it); repeated rows are in one shard under slots of their own; ties in
the hash order cannot arise but for equal hashes, which are one group; an
empty table gives no rows.  Columns of the input other than id and text are
kept by ``shard_documents`` unless an output column has their name.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SHARDS = 16
FIRST_BITS, STEP_BITS = 16, 8
#: Rows of a bucket in which slots are numbered.
BUCKET_ROWS = 100_000


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class PrefixIndex:
    """Prefix sums of group sizes at known positions of the key order.

    Positions are key ranges ``[start, end)`` on the unsigned axis 0..2**64
    with the bytes and groups they hold; ranges with one group are atoms.
    """

    def __init__(self, ranges: list[tuple[int, int, int]]):
        """``ranges``: (first key, bytes, groups), in key order, none empty."""
        self.start = [r[0] for r in ranges]
        self.groups = [r[2] for r in ranges]
        self.cum = [0]
        for r in ranges:
            self.cum.append(self.cum[-1] + r[1])

    def cuts(self, capacity: int, shards: int, fill_last: bool) -> list[int] | None:
        """Greedy cuts at range boundaries (range numbers), None if more shards are needed.

        A range of several groups on which a shard ends goes wholly into the
        shard (``fill_last``: an optimistic bound) or to the next one (a
        pessimistic bound); for atoms both are exact.
        """
        out, at, n = [], 0, len(self.groups)
        for _ in range(shards):
            end = bisect.bisect_right(self.cum, self.cum[at] + capacity) - 1
            if end < n and fill_last and self.groups[end] > 1:
                end += 1
            if end >= n:
                return out
            if end == at:
                return None
            out.append(end)
            at = end
        return None

    def search(self, shards: int, low: int, high: int, fill_last: bool) -> int:
        """Smallest capacity in [low, high] that is feasible, else ``high``."""
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, fill_last) is None:
                low = mid + 1
            else:
                high = mid
        return low


def _ranges(groups: DataFrame, bits: int, inside: list[int] | None, above: int) -> list[tuple[int, int, int]]:
    """Bytes and groups by the top ``bits`` of the key; ``inside``: only these ranges of ``above`` bits."""
    part = F.shiftrightunsigned("key", 64 - bits) if bits < 64 else F.col("key")
    if inside is not None:
        keep = groups.sparkSession.createDataFrame([(_signed(i, above),) for i in inside], "r bigint")
        groups = groups.join(F.broadcast(keep), F.shiftrightunsigned("key", 64 - above) == F.col("r"), "left_semi")
    rows = groups.groupBy(part.alias("r")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("g")).collect()
    return sorted(((r["r"] % (1 << 64)) << (64 - bits), r["b"], r["g"]) for r in rows)


def _signed(value: int, bits: int) -> int:
    return value - (1 << 64) if bits == 64 and value >= 1 << 63 else value


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """Smallest capacity and the unsigned keys at which shards 1, 2, ... start.

    ``groups(key bigint, size bigint)``: one row per atomic group.
    """
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return 0, []
    bits, ranges = FIRST_BITS, _ranges(groups, FIRST_BITS, None, 0)
    low, high = max(-(-total // shards), largest), total
    while True:
        index = PrefixIndex(ranges)
        low = index.search(shards, low, high, True)
        high = index.search(shards, low, high, False)
        # ranges on which a shard may end, for any capacity left
        open_ranges = set()
        first = last = 0
        for _ in range(shards):
            a = bisect.bisect_right(index.cum, index.cum[first] + low) - 1
            b = bisect.bisect_right(index.cum, index.cum[last] + high) - 1
            open_ranges.update(i for i in range(a, min(b, len(ranges) - 1) + 1)
                               if i < len(ranges) and ranges[i][2] > 1)
            first, last = min(a, len(ranges) - 1), min(b + 1, len(ranges))
        if not open_ranges:
            low = index.search(shards, low, high, False)
            return low, [index.start[i] for i in index.cuts(low, shards, False)]
        # every open range has width 2**(64 - its bits); all of one round share it
        finer = min(64, bits + STEP_BITS)
        wide = [ranges[i][0] >> (64 - bits) for i in open_ranges]
        fresh = _ranges(groups, finer, sorted(set(wide)), bits)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_ranges] + fresh)
        bits = finer


def plan_shards(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int]]:
    """(keys of groups with a shard of their own, first keys of the later shards).

    A group larger than the mean of the shards still open makes the largest
    shard whatever is cut, so it comes first in the order, alone; the minimax
    partition then levels the rest (there are fewer such groups than shards).
    """
    top = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    rest, alone = groups.agg(F.sum("size")).first()[0] or 0, []
    for row in top:
        if row["size"] * (shards - len(alone)) <= rest:
            break
        alone.append(row["key"])
        rest -= row["size"]
        if not rest:
            return alone, []
    if alone:
        groups = groups.filter(~F.col("key").isin(alone))
    return alone, minimax_cuts(groups, shards - len(alone))[1]


def shard_of(key: Column, plan: tuple[list[int], list[int]]) -> Column:
    """Shard number of a signed 64-bit key (compared in unsigned order)."""
    alone, starts = plan
    order = key.bitwiseXOR(F.lit(-(1 << 63)))
    out = F.lit(len(alone))
    for n, start in enumerate(starts, len(alone) + 1):
        out = F.when(order >= F.lit(start - (1 << 63)), F.lit(n)).otherwise(out)
    for n, own in enumerate(alone):
        out = F.when(key == F.lit(own), F.lit(n)).otherwise(out)
    return out.cast("int")


def _slots(rows: DataFrame, order: list[str], bucket_rows: int) -> DataFrame:
    """``rows`` with a ``slot`` gapless from 0 within ``shard``."""
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows), min(64, n // 1000))
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    inside = Window.partitionBy("shard", "__b").orderBy(*order)
    return dealt.join(offsets, ["shard", "__b"]).withColumn(
        "slot", (F.row_number().over(inside) - 1 + F.col("__off")).cast("long")).drop("__b", "__off")


def shard_frame(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard (null for this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text).alias("text_crc32"), text_key(F.col(text_col)).alias("key")))
    plan = plan_shards(materialize(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    rows = rows.withColumn("shard", shard_of(F.col("key"), plan))
    rows = _slots(rows, ["__id", "key", "size"], bucket_rows)
    return rows.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (and the group key's order inside it as ``shard_key``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = materialize(docs.select(text_key(F.col(text_col)).alias("key"), (F.octet_length(text) + 1).alias("n"))
                         .groupBy("key").agg(F.sum("n").alias("size")))
    key = text_key(F.col(text_col))
    return docs.withColumns({"shard": shard_of(key, plan_shards(groups, shards)), "shard_key": key})
