"""Ranked lexical search with the Best Position Algorithm.

``build_index`` cuts the documents into shards of bounded text and writes
one row per (shard, term): the documents that hold the term and how often.
Every document and every term is indexed.  The corpus figures of the score
(documents, terms, documents of a term) are sums over the index.

``search`` takes the queries in blocks of bounded text.  Only the lists of a
block's terms leave the index; the lists of one shard come together in one
task, whatever the number of documents that hold a term.  There each list is
ordered by impact, and a query reads its lists in parallel from the top.
Each new document is looked up directly in all other lists, which gives its
score and its position in them.  The best position of a list is the last one
of the run of seen positions that starts at its top; the weighted impacts at
the best positions bound the score of every unseen document, tighter than
the positions read last.  A query stops when that bound is strictly below
its k-th score, so ties at the k-th place are all seen.  The k best so far
go with the task from shard to shard, which stops later shards sooner.
Shards, then groups of tasks, then all are reduced to k rows a query.

Defined cases: null and empty texts and texts without a term are in no list
and count in no figure; repeated rows are documents of their own; null ids
rank after all others of their score; queries without a term or with a null
text have no rows, repeated queries each have theirs; a term that no
document holds adds nothing; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Text of one shard, text of one block of queries, tasks whose results one further task reduces.
SHARD_BYTES, BLOCK_BYTES, FAN_IN = 8 << 20, 4 << 20, 1024
#: Positions a query reads of each list in its first step; each next step reads twice as many.
FIRST_STEP = 16
#: ASCII letters in lower case and digits; all other ASCII separates terms, other bytes belong to them.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def _index_rows(id_type: pa.DataType, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for part in slices(batches, "t", shard_bytes, 1 << 16):
            found, lengths = [], []
            for text in part.column("t").to_pylist():
                own = terms(text)
                found += own
                lengths.append(len(own))
            coded = pa.array(found, pa.binary()).dictionary_encode()
            del found
            n, lengths = part.num_rows, np.array(lengths, np.int64)
            key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
            key, tf = np.unique(key, return_counts=True)
            sizes = np.bincount(key // n, minlength=len(coded.dictionary))
            # the row without a term has the documents themselves
            at = pa.array(np.r_[0, 0, np.cumsum(sizes)].astype(np.int32))
            rows = len(sizes) + 1
            own = pa.array(np.r_[0, np.full(rows, n)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, shard)), pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.cast(pa.string())]),
                 pa.ListArray.from_arrays(at, pa.array((key % n).astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32))),
                 pa.ListArray.from_arrays(own, part.column("id").cast(id_type)),
                 pa.ListArray.from_arrays(own, pa.array(lengths))], ["shard", "term", "docs", "tf", "ids", "lengths"])
            shard += 1
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(shard, term, docs[], tf[], ids[], lengths[])``, written; ``ids`` and ``lengths`` are in the row without a term."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _index_rows(to_arrow_type(kind), shard_bytes),
        f"shard bigint, term string, docs array<int>, tf array<int>, ids array<{kind.simpleString()}>, lengths array<bigint>"))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, name, size, term)`` of every query's distinct terms; ``item`` tells rows apart."""
    rows = materialize(queries.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("name"),
                                      F.coalesce(F.col(text_col), F.lit("")).alias("t")))
    return rows.select("item", "name", F.length("t").alias("size"), F.explode(F.array_distinct(
        F.regexp_extract_all(_lowered(F.col("t")), F.lit(TERM), F.lit(0)))).alias("term"))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``10**9 * tf / (1000 * tf + 8 * m)`` rounded down, ``m`` from the document's length ``n``."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        m = np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    else:
        m = 10 + 90 * n * documents // max(total, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class ImpactLists:
    """The lists of one shard: by document for direct access, by impact for sorted access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        """Postings ordered by (term, doc); terms are codes from 0."""
        self.docs, self.impact = docs, impact
        self.key = term * docs + doc
        self.by_impact = np.lexsort((doc, -impact, term))
        self.terms, self.first, self.size = np.unique(term, return_index=True, return_counts=True)
        place = np.empty(len(term), np.int64)
        place[self.by_impact] = np.arange(len(term))
        self.position = place - np.repeat(self.first, self.size)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, top: np.ndarray,
             first_step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the ``k`` best, their scores, and the positions read.

        ``top``: scores known already (at most ``k``).  Every document with a
        positive score not below the k-th one is returned.
        """
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (weights > 0)
        here[here] &= self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        first, size, key0 = self.first[at], self.size[at], self.terms[at] * self.docs
        base = np.cumsum(size) - size
        seen_at = np.zeros(int(size.sum()), bool)  # positions of all lists, one list after the other
        seen = np.zeros(self.docs, bool)
        best = np.zeros(len(at), np.int64)  # best positions: all before are seen
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, read = 0, first_step, 0
        while len(at) and depth < size.max():
            count = np.clip(size - depth, 0, step)
            own = np.repeat(first + depth - np.cumsum(count) + count, count) + np.arange(count.sum())
            new = np.unique(self.key[self.by_impact[own]] % self.docs)
            new = new[~seen[new]]
            seen[new] = True
            # direct accesses: each new document in every list
            want = key0[:, None] + new
            where = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            holds = self.key[where] == want
            found = np.r_[found, new]
            scores = np.r_[scores, (np.where(holds, self.impact[where], 0) * weights[:, None]).sum(0)]
            seen_at[(base[:, None] + self.position[where])[holds]] = True
            depth, step, read = depth + step, 2 * step, read + int(count.sum())
            gaps = np.flatnonzero(~seen_at)
            gap = np.searchsorted(gaps, base)
            best = np.minimum(np.append(gaps, len(seen_at))[gap] - base, size)
            if len(top) + len(scores) >= k:
                ranked = np.r_[top, scores]
                kth = np.partition(ranked, len(ranked) - k)[len(ranked) - k]
                # an exhausted list has nothing left to add
                ends = np.where(best < size, self.impact[self.by_impact[first + best - 1]], 0)
                if (ends * weights).sum() < kth:
                    break
        ranked = np.r_[top, scores]
        kth = np.partition(ranked, len(ranked) - k)[len(ranked) - k] if len(ranked) >= k else 0
        keep = scores >= max(kth, 1)
        return found[keep], scores[keep], read


def _search_rows(bundle, documents: int, total: int, k: int, name_type: pa.DataType, id_type: pa.DataType):
    def order(entry):
        return (-entry[0], entry[1] is None, entry[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, names, codes, weights = bundle.value
        tops = [[] for _ in items]

        def one_shard(rows: list[tuple]):
            (ids, lengths), = [(r[4], r[5]) for r in rows if r[1] is None]
            lists = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
            if not lists:
                return
            term = np.repeat([r[1] for r in lists], [len(r[2]) for r in lists])
            doc = np.concatenate([r[2] for r in lists]).astype(np.int64)
            tf = np.concatenate([r[3] for r in lists]).astype(np.int64)
            own = ImpactLists(term, doc, impacts(tf, lengths[doc], documents, total), len(lengths))
            for i, (c, w) in enumerate(zip(codes, weights)):
                found, scores, _ = own.best(c, w, k, np.array([s for s, _ in tops[i]], np.int64))
                if len(found):
                    tops[i] = heapq.nsmallest(k, tops[i] + [
                        (s, ids[d].as_py()) for d, s in zip(found.tolist(), scores.tolist())], key=order)

        shard, rows = None, []
        for batch in batches:
            lists = [batch.column(c) for c in ("docs", "tf", "ids", "lengths")]
            for i, (s, c) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("code").to_pylist())):
                if s != shard and rows:
                    one_shard(rows)
                    rows = []
                shard = s
                docs, tf, ids, lengths = (x[i].values for x in lists)
                rows.append((s, c, docs.to_numpy(), tf.to_numpy(), ids, lengths.to_numpy()) if c is not None
                            else (s, c, None, None, ids, lengths.to_numpy()))
        if rows:
            one_shard(rows)
        out = [(item, name, s, d) for item, name, top in zip(items, names, tops) for s, d in top]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], name_type), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], id_type), pa.array([TaskContext.get().partitionId()] * len(out), pa.int64())],
            ["item", "name", "score", "id", "task"])
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(name, rank, id, score)``: the ``k`` best documents with a positive score of each query."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = index.sparkSession
    doc_kind, name_kind = index.schema["ids"].dataType.elementType, queries.schema[id_col].dataType
    figures = index.filter("term IS NULL").select(F.explode("lengths").alias("n")).filter("n > 0").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, total = figures
    wanted = materialize(_query_terms(queries, id_col, text_col))
    held = index.join(wanted.select("term").distinct(), "term").groupBy("term").agg(
        F.sum(F.size("docs")).alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * documents + 2)) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    wanted = materialize(wanted.join(held, "term").select("item", "name", "size", "term", weight.alias("weight")))
    text = wanted.select("item", "size").distinct().agg(F.sum("size")).first()[0] or 0
    blocks = -(-text // block_bytes)
    out = None
    for b in range(max(blocks, 1)):
        block = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else wanted
        rows = block.select("item", "name", "term", "weight").collect()
        code = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault((r["item"], r["name"]), []).append((code[r["term"]], r["weight"]))
        bundle = spark.sparkContext.broadcast((
            [i for i, _ in by_item], [n for _, n in by_item], [np.array([c for c, _ in v], np.int64) for v in by_item.values()],
            [np.array([w for _, w in v], np.int64) for v in by_item.values()]))
        codes = spark.createDataFrame(list(code.items()), "term string, code bigint")
        lists = index.join(F.broadcast(codes), "term", "left").filter("code IS NOT NULL OR term IS NULL")
        lists = lists.select("shard", "code", "docs", "tf", "ids", "lengths").repartition("shard").sortWithinPartitions("shard")
        found = lists.mapInArrow(
            _search_rows(bundle, documents, total, k, to_arrow_type(name_kind), to_arrow_type(doc_kind)),
            f"item bigint, name {name_kind.simpleString()}, score bigint, id {doc_kind.simpleString()}, task bigint")
        out = found if out is None else out.unionByName(found)
    best = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["item", (F.col("task") / FAN_IN).cast("long")], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= k)
    return out.select("name", "rank", "id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                     query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Per query its ``k`` best documents: query id, rank, document id, score."""
    found = search(build_index(docs, id_col, text_col), queries, k, query_id, query_text)
    return found.select(F.col("name").alias(query_id), "rank", F.col("id").alias(id_col), "score")
