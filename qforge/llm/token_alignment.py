"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both token sequences spell the same bytes, so their tokens end at byte
offsets of one scale; an offset where a token of each ends is a shared cut.
``shared_cuts`` looks in every interval for the cut nearest to the middle of
its ends of the first tokenizer, testing ends outwards by bisect in the ends
of the second, cuts there and goes on with both halves; an interval without
a cut is a leaf, one group.  What was tested between the middle and the cut
is known to be cutless and is not tested again.  All intervals of a slice of
documents take their step together in numpy.

Every token pair of a group is a link.  A pair of ids counts the documents
that hold it linked; a document then carries, over its links, the sum of the
counts and how many links are the most counted ones of their first id.  The
counts are summed inside tasks before they are shuffled.  The most frequent
``HOT_PAIRS`` pairs are looked up in a broadcast array (17 bytes each), all
others are joined, so no frequent pair is ever a join key and no pair is
left out.

The vocabulary files are read by the driver and broadcast (a few megabytes);
executors need no local file.

Defined cases: null and empty texts, and texts that one of the tokenizers
does not spell back exactly, have no tokens: zeros and an empty digest.
Repeated rows and ids are rows of their own, each counted; an empty table
gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs whose counts are broadcast; pairs a counting task holds before it passes them on.
HOT_PAIRS, HELD_PAIRS = 1 << 19, 1 << 20
#: Text of one slice, and characters from which the slower encoder without a stack limit is used.
SLICE_BYTES, LONG_TEXT = 2 << 20, 100_000
#: Token pairs of a group from which it is counted by distinct ids.
WIDE_GROUP = 4096
#: Fixed value: the word pattern of the byte-level vocabulary.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Byte-level BPE from a tokenizer file; special tokens in a text are plain text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        alphabet = _byte_alphabet()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        spelled = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.tokens = [b""] * size
        for b, i in spelled.items():
            self.tokens[i] = b
        self._slow = Tokenizer.from_str(definition)
        self._slow.encode_special_tokens = True
        # the fast encoder takes ids as merge ranks, which holds if merges are numbered in order
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ids = [vocab[m] for m in merged]
        self._fast = tiktoken.Encoding("own", pat_str=_BYTE_PATTERN, mergeable_ranks=spelled, special_tokens={}) \
            if ids == sorted(ids) else None

    def encode(self, text: str) -> list[int]:
        if self._fast is None or len(text) > LONG_TEXT:
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


class PieceEncoder:
    """Sentence pieces with byte fallback; the model puts a space before the text."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, self._model.id_to_piece(i)) for i in range(self._model.get_piece_size()))]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text)


@lru_cache(maxsize=2)
def _encoders(definition: str, model: bytes) -> tuple[ByteEncoder, PieceEncoder]:
    return ByteEncoder(definition), PieceEncoder(model)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) one after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def shared_cuts(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices into ``a`` of the ends that are in ``b`` too, in each interval ``left:right``.

    ``a`` and ``b`` ascend; the last of ``b`` is not below any of ``a``.
    """
    found, reach = [], np.zeros(len(left), np.int64)
    keep = left < right
    left, right, reach = left[keep], right[keep], reach[keep]
    while len(left):
        middle = (left + right) // 2
        low, high = np.maximum(left, middle - reach), np.minimum(right, middle + reach + 1)
        counts = high - low
        at = _ragged(low, counts)
        ends = a[at]
        away = at - np.repeat(middle, counts)
        rank = np.where(b[np.searchsorted(b, ends)] == ends, 2 * np.abs(away) + (away > 0), np.iinfo(np.int64).max)
        nearest = np.minimum.reduceat(rank, np.cumsum(counts) - counts)
        hit = nearest != np.iinfo(np.int64).max
        wider = ~hit & (counts < right - left)
        gap = nearest[hit] // 2
        after = nearest[hit] % 2 == 1
        mid = middle[hit]
        cut = np.where(after, mid + gap, mid - gap)
        found.append(cut)
        # halves without what lies between the middle and the cut
        first = np.where(after, mid - gap, cut)
        second = np.where(after | (gap == 0), cut + 1, mid + gap)
        left, right, reach = (np.concatenate([np.stack([left[hit], second], 1).ravel(), left[wider]]),
                              np.concatenate([np.stack([first, right[hit]], 1).ravel(), right[wider]]),
                              np.concatenate([np.zeros(2 * len(cut), np.int64), 2 * reach[wider] + 1]))
        keep = left < right
        left, right, reach = left[keep], right[keep], reach[keep]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Alignment:
    """Groups and linked id pairs of a slice of documents.

    ``a``/``b``: ids of the documents one after the other, ``na``/``nb``: how
    many each has (both or none), ``la``/``lb``: bytes of each id.
    """

    def __init__(self, a, b, na, nb, la, lb):
        self.a, self.b, self.docs = a, b, len(na)
        ends_a, ends_b = np.cumsum(la[a]), np.cumsum(lb[b])
        stop = np.cumsum(na)
        whole = stop[na > 0] - 1
        cuts = np.sort(np.concatenate([shared_cuts(ends_a, ends_b, (stop - na)[na > 0], whole), whole]))
        cuts_b = np.searchsorted(ends_b, ends_a[cuts])
        self.start_a, self.start_b = np.r_[0, cuts + 1][:-1], np.r_[0, cuts_b + 1][:-1]
        self.size_a, self.size_b = cuts + 1 - self.start_a, cuts_b + 1 - self.start_b
        self.doc = np.repeat(np.arange(len(na)), na)[cuts]
        self.n_groups = np.bincount(self.doc, minlength=len(na))
        links = np.zeros(len(na), np.int64)
        np.add.at(links, self.doc, self.size_a * self.size_b)
        self.n_links = links

    def spelled(self, text_a: list[str], text_b: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document; ids as the given texts."""
        place_a = np.arange(len(self.a)) + np.repeat(self.start_b, self.size_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.start_a + self.size_a, self.size_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.start_a + self.size_a - 1] = 1
        last_b[self.start_b + self.size_b - 1] = 1
        code[place_a], code[place_b] = 2 * self.a + last_a, 2 * len(text_a) + 2 * self.b + last_b
        parts = [x + end for texts, last in ((text_a, "|"), (text_b, ";")) for x in texts for end in (",", last)]
        ends = np.zeros(self.docs, np.int64)
        np.add.at(ends, self.doc, self.size_a + self.size_b)
        out, at, flat = [], 0, code.tolist()
        for size in ends.tolist():
            out.append("".join([parts[c] for c in flat[at:at + size]])[:-1])
            at += size
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, links) of each document's distinct pairs, ordered; a pair is ``a << 16 | b``."""
        size = self.size_a * self.size_b
        few = size <= WIDE_GROUP
        g = np.repeat(np.flatnonzero(few), size[few])
        k = _ragged(np.zeros(int(few.sum()), np.int64), size[few])
        key = (self.doc[g] << 32) | (self.a[self.start_a[g] + k // self.size_b[g]] << 16) | self.b[self.start_b[g] + k % self.size_b[g]]
        key, times = np.unique(key, return_counts=True)
        if not few.all():
            keys, counts = [key], [times]
            for w in np.flatnonzero(~few):
                ids_a, n_a = np.unique(self.a[self.start_a[w]:][:self.size_a[w]], return_counts=True)
                ids_b, n_b = np.unique(self.b[self.start_b[w]:][:self.size_b[w]], return_counts=True)
                keys.append(((self.doc[w] << 32) | (ids_a[:, None] << 16) | ids_b).ravel())
                counts.append((n_a[:, None] * n_b).ravel())
            key, times = _summed(np.concatenate(keys), np.concatenate(counts))
        return key >> 32, key & 0xFFFFFFFF, times


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their ``n``."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _list_column(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values).cast(kind))


def _spelling(encoder, text: str, want: bytes) -> list[int] | None:
    """Ids of ``text`` if their bytes are ``want``."""
    ids = encoder.encode(text)
    return ids if b"".join([encoder.tokens[i] for i in ids]) == want else None


def _align_rows(files, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _encoders(*files.value)
        la, lb = (np.fromiter(map(len, e.tokens), np.int64, len(e.tokens)) for e in (one, two))
        text_a, text_b = ([str(i) for i in range(len(e.tokens))] for e in (one, two))
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, "t", SLICE_BYTES):
            a, b, na, nb = [], [], [], []
            for text in part.column("t").to_pylist():
                ids = other = None
                if text:
                    want = (" " + text).encode()
                    ids = _spelling(one, " " + text, want)
                    other = _spelling(two, text, want) if ids is not None else None
                if other is None:
                    ids, other = [], []
                a += ids
                b += other
                na.append(len(ids))
                nb.append(len(other))
            na, nb = np.array(na, np.int64), np.array(nb, np.int64)
            got = Alignment(np.array(a, np.int64), np.array(b, np.int64), na, nb, la, lb)
            groups = got.spelled(text_a, text_b)
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            doc, pair, times = got.pairs()
            sizes = np.bincount(doc, minlength=got.docs)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(row + np.arange(got.docs)), pa.array(na), pa.array(nb),
                 pa.array(got.n_groups.astype(np.int64)), pa.array(got.n_links), pa.array(groups, pa.string()),
                 _list_column(pair, sizes, pa.int64()), _list_column(times, sizes, pa.int64())],
                ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
            row += got.docs
    return run


def encode_and_align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                     piece_bpe: str = PIECE_BPE, digest: bool = False) -> DataFrame:
    """Per document: id, row, token, group and link counts, ``groups``, distinct id ``pairs`` and their links ``times``."""
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _align_rows(files, digest), f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups string, pairs array<bigint>, times array<bigint>")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, summed in the task up to ``HELD_PAIRS`` pairs at a time."""
    def out(pair, n):
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        own = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
        pair, n = _summed(np.concatenate([pair, own]), np.concatenate([n, np.ones(len(own), np.int64)]))
        if len(pair) > HELD_PAIRS:
            yield out(pair, n)
            pair, n = pair[:0], n[:0]
    yield out(pair, n)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: documents that hold the pair linked; whether no pair of its first id has more."""
    counts = materialize(aligned.select("pairs").mapInArrow(_count_rows, "pair bigint, n bigint")
                         .groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.shiftright("pair", 16)
    # one row an id of the first vocabulary
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return materialize(counts.withColumn("a", first).join(F.broadcast(most), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _sum_rows(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = hot.value
        for batch in batches:
            lists = batch.column("pairs")
            own, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums, tops = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, doc[known], times[known] * n[at[known]])
            np.add.at(tops, doc[known], times[known] * best[at[known]])
            rest = np.bincount(doc[~known], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(tops), pa.array(sums),
                 _list_column(own[~known], rest, pa.int64()), _list_column(times[~known], rest, pa.int64())],
                ["row", "tops", "sums", "pairs", "times"])
    return run


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                     piece_bpe: str = PIECE_BPE, digest: bool = False, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups (or their SHA-256)."""
    aligned = materialize(encode_and_align(docs, id_col, text_col, byte_bpe, piece_bpe, digest))
    counts = pair_counts(aligned)
    top = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toPandas().sort_values("pair")
    hot = docs.sparkSession.sparkContext.broadcast(
        tuple(top[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.int64))))
    sums = materialize(aligned.select("row", "pairs", "times").mapInArrow(
        _sum_rows(hot), "row bigint, tops bigint, sums bigint, pairs array<bigint>, times array<bigint>"))
    cold = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    cold = cold.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tops"),
        F.sum(F.col("times") * F.col("n")).alias("sums"))
    total = sums.select("row", "tops", "sums").unionByName(cold).groupBy("row").agg(
        F.sum("tops").alias("n_best"), F.sum("sums").alias("count_sum"))
    name = "groups_sha256" if digest else "groups"
    return aligned.drop("pairs", "times").join(total, "row").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias(name))
