"""Ranked search, tokenizer alignment and the Jaccard join against brute force and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from qforge.llm import best_position as bp
from qforge.llm import signature_trees as st
from qforge.llm import token_alignment as ta
from qforge.llm.queries import ORACLES, QUERIES

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall())


# 11 -------------------------------------------------------------------------
def brute_search(docs, query, k=10):
    split = lambda t: re.findall(bp.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    scored = defaultdict(int)
    for term in set(split(query)):
        df = sum(term in b for _, b, _ in bags)
        if df:
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for i, (d, b, n) in enumerate(bags):
                if term in b:
                    scored[i] += w * (1_000_000_000 * b[term] // (1000 * b[term] + 8 * (10 + 90 * n * n_docs // total)))
    rows = [(-s, bags[i][0] is None, bags[i][0]) for i, s in scored.items() if s > 0]
    return [(r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(rows)[:k])]


def test_best_positions_stop_early_and_miss_nothing():
    rng = np.random.default_rng(3)
    stopped = 0
    for _ in range(60):
        n, m = int(rng.integers(5, 400)), int(rng.integers(1, 6))
        rows = [(t, d) for t in range(m) for d in range(n) if rng.random() < 0.7]
        term, doc = (np.array(x, np.int64) for x in zip(*rows))
        impact = (1000 / (1 + rng.integers(0, 60, len(rows)))).astype(np.int64)
        lists = bp.ImpactLists(term, doc, impact, n)
        w = rng.integers(0, 9, m)
        found, scores, read = lists.best(np.arange(m), w, 10, np.zeros(0, np.int64), first_step=2)
        want = np.zeros(n, np.int64)
        np.add.at(want, doc, impact * w[term])
        kth = np.sort(want)[::-1][:10][-1] if n >= 10 else 0
        assert dict(zip(found.tolist(), scores.tolist())) == {d: s for d, s in enumerate(want.tolist()) if s >= max(kth, 1)}
        stopped += read < len(rows) - 20
    assert stopped > 5


def test_search_odd_rows_and_shards(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "ALPHA-beta words x"), (1, "ALPHA-beta words x"), (2, None), (3, ""), (4, "---"), (None, "lone"),
                                   (5, "nowhere")], "item_id bigint, text string").withColumn("term", F.lit(1)).withColumn("id", F.lit(2))
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for size in (8 << 20, 40):  # one shard, and a shard a document
        index = bp.build_index(odd_docs, shard_bytes=size)
        for block in (4 << 20, 8):
            got = defaultdict(list)
            for r in bp.search(index, items, block_bytes=block).collect():
                got[r["name"]].append((r["rank"], r["id"], r["score"]))
            want = brute_search(docs, "alpha beta words x")
            assert sorted(got[1], key=str) == sorted(want * 2, key=str)
            assert got[None] == brute_search(docs, "lone") and set(got) == {1, None}
    assert bp.search_documents(no_docs, items).count() == 0
    assert bp.search_documents(odd_docs, items.limit(0)).count() == 0


def test_ties_take_the_smallest_ids(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(40, 0, -1)], "doc_id bigint, text string").repartition(7)
    items = spark.createDataFrame([(1, "words")], "item_id bigint, text string")
    got = bp.search(bp.build_index(docs, shard_bytes=30), items).collect()
    # all documents hold the word: its weight is 1000 * ln(82 / 81), rounded down
    assert sorted((r["rank"], r["id"]) for r in got) == [(i, i) for i in range(1, 11)] and {r["score"] for r in got} == {12 * (10 ** 9 // 1800)}


def test_impacts_do_not_overflow():
    n = np.array([10 ** 9, 1])
    assert bp.impacts(np.array([1, 1]), n, 10 ** 11, 10 ** 14).tolist() == [
        10 ** 9 // (1000 + 8 * (10 + 90 * 10 ** 20 // 10 ** 14)), 10 ** 9 // (1000 + 8 * 10)]


def test_op11_against_brute_force(spark, texts):
    items = duckdb.sql(f"select item_id, text from '{SF001}/benchmark.parquet' order by item_id").fetchall()
    got = defaultdict(list)
    for r in QUERIES["op11_best_position"](spark, SF001).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for i, t in items[:8]:
        assert sorted(got[i]) == brute_search(list(texts.items()), t)
    assert "op11_best_position" in ORACLES


# 12 -------------------------------------------------------------------------
def test_shared_cuts_equal_the_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b, left, right, want, at = [], [], [], [], [], 0
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(1, 120))
            x, y = ({*rng.integers(1, n + 1, rng.integers(0, n + 1)).tolist(), n} for _ in "ab")
            left.append(len(a))
            want += [len(a) + i for i, e in enumerate(sorted(x)) if e in y and e < n]
            a += [at + e for e in sorted(x)]
            b += [at + e for e in sorted(y)]
            right.append(len(a) - 1)
            at += n
        assert ta.shared_cuts(*map(np.array, (a, b, left, right))).tolist() == want
    # one cut at the far end of a long cutless stretch
    assert ta.shared_cuts(np.arange(1, 100_001), np.array([3, 100_000]), np.array([0]), np.array([99_999])).tolist() == [2]


def brute_alignment(docs):
    one, two = (open(p, "rb").read() for p in (ta.BYTE_BPE, ta.PIECE_BPE))
    from tokenizers import Tokenizer
    slow = Tokenizer.from_buffer(one)
    slow.encode_special_tokens = True
    first, second = ta.ByteEncoder(one.decode()), ta.PieceEncoder(two)
    rows, holds = [], Counter()
    for d, t in docs:
        a = slow.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        spelled = [b"".join(e.tokens[i] for i in ids) for e, ids in ((first, a), (second, b))]
        if not t or spelled != [(" " + t).encode()] * 2:
            rows.append((d, 0, 0, [], Counter()))
            continue
        groups, ga, gb, ea, eb, rest = [], [], [], 0, 0, list(b)
        for x in a:
            ga.append(x)
            ea += len(first.tokens[x])
            while rest and eb + len(second.tokens[rest[0]]) <= ea:
                eb += len(second.tokens[rest[0]])
                gb.append(rest.pop(0))
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        holds.update(set(links))
        rows.append((d, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    for d, na, nb, groups, links in rows:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (d, na, nb, len(groups), sum(links.values()), sum(n for l, n in links.items() if holds[l] == most[l[0]]),
               sum(n * holds[l] for l, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "")


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op12_against_brute_force(spark, texts):
    assert as_rows(QUERIES["op12_shared_cuts"](spark, SF001)) == sorted(brute_alignment(texts.items()), key=str)


def test_alignment_odd_rows(spark, odd_docs, no_docs):
    rows = [(1, "a  b\t\n<|endoftext|> <s> ½²漢字 é 😀"), (2, "▁joined"), (3, "<0x0A>"), (4, " "), (5, "\x00\x85"),
            (6, "".join(random.Random(2).choice("abcdef") for _ in range(150_000))), (7, " " * 150_000)]
    extra = {c: F.lit(1) for c in ("row", "pairs", "times", "n_a")}
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumns(extra)
    want = sorted(brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    for hot in (1 << 19, 40, 0):  # all pairs looked up, some, none
        assert as_rows(ta.align_tokenizers(docs, digest=True, hot_pairs=hot)) == want
    assert next(r for r in want if r[0] == 2)[1:] == (0,) * 6 + ("",)
    assert ta.align_tokenizers(no_docs).count() == 0


def test_groups_are_spelled_out(spark):
    got = ta.align_tokenizers(spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string")).first()
    assert re.fullmatch(r"\d+(,\d+)*\|\d+(,\d+)*(;\d+(,\d+)*\|\d+(,\d+)*)*", got["groups"]) and got["n_groups"] == 2


def test_wide_groups_count_like_narrow_ones(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    la, lb = np.full(9, 2), np.full(9, 3)
    full = ta.Alignment(a, b, np.array([300]), np.array([200]), la, lb).pairs()
    monkeypatch.setattr(ta, "WIDE_GROUP", 2)
    assert all(np.array_equal(x, y) for x, y in zip(full, ta.Alignment(a, b, np.array([300]), np.array([200]), la, lb).pairs()))


# 13 -------------------------------------------------------------------------
def brute_components(docs, shingle=4, percent=85):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)] += [d] if d is not None else []
    return sorted(((d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def near_copies(n_groups, copies, seed, length=60):
    """Texts of a few families, each copy with some words changed, around the threshold."""
    rng = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(length)] = f"x{rng.randrange(5000)}"
            out.append(" ".join(own[rng.randrange(3):]))
    return list(enumerate(out))


def test_op13_against_brute_force(spark, texts):
    assert as_rows(QUERIES["op13_signature_trees"](spark, SF001)) == brute_components(list(texts.items()))
    assert "op13_signature_trees" in ORACLES


@pytest.mark.parametrize("blocks", [(2048, 1 << 20), (5, 1 << 20), (2048, 300)])
def test_links_in_one_block_and_in_many(spark, blocks):
    docs = near_copies(6, 25, 7)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = st.jaccard_components(df, block_sets=blocks[0], block_shingles=blocks[1])
    assert as_rows(got) == brute_components(docs)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    extra = {c: F.lit(1) for c in ("v", "family", "task", "block", "root", "component")}
    assert as_rows(st.jaccard_components(odd_docs.withColumns(extra))) == brute_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert st.jaccard_components(no_docs).count() == 0


def test_signature_tree_finds_the_components():
    rng = np.random.default_rng(6)
    for percent, fan_out in ((85, 2), (60, 3), (85, 8)):
        sets = []
        for _ in range(12):
            base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
            sets += [np.unique(np.where(rng.random(40) < rng.choice([0, 0.05, 0.1]), rng.integers(0, 1 << 63, 40).astype(np.uint64), base))
                     for _ in range(9)]
        rng.shuffle(sets)
        got = st.SignatureTree(sets, percent, fan_out).components(np.arange(len(sets)))
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(x & y) >= percent * len(x | y):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert got.tolist() == root


def test_first_pairs_share_one_in_any_order():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(5, 60))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)])
        known = np.sort(rng.choice(x, len(x) // 2, replace=False))
        frequent = known, rng.permutation(len(known)).astype(np.int32) + 1
        if st.linked(x, y) and not np.array_equal(x, y):
            assert np.intersect1d(st.first_pairs(x, frequent), st.first_pairs(y, frequent)).size
