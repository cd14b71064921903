"""The pipeline against brute force, and faults found by review: clashing names, null paths, numeric signs, long runs."""

import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qforge.llm import feistel_pii, language_mixture, license_cosine, mixture_raking, simhash_bktree, string_tiling
from qforge.llm.common import free_names
from qforge.llm.queries import ORACLES

SF001 = "/root/testdata/sf0.001"
NAMES = ("__u", "__p", "__h", "__gone", "__gone_h", "__source", "U", "P", "h", "gone", "gone_", "SOURCE_", "topic", "s", "task", "v")


def crossed(rows, key):
    """Rows by id; the tables of these tests have each id once."""
    return {r[key]: r for r in rows}


def brute_near_duplicates(docs):
    prints = [(d, simhash_bktree.simhash(t)) for d, t in docs]
    root = list(range(len(prints)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        groups[find(i)].append(d)
    return {min(g) for g in groups.values()}


def brute_leaks(docs, items):
    found = set()
    for d, t in docs:
        w = string_tiling.tokens(t)
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for x in items:
            v = string_tiling.tokens(x)
            covered = {p for j in range(len(v) - 4) if tuple(v[j:j + 5]) in grams for p in range(j, j + 5)}
            if v and len(covered) >= 0.8 * len(v):
                found.add(d)
    return found


def brute_raking(rows, budget=0.9, alpha=0.8):
    """Probability of each (source, lang, topic) by plain proportional fitting."""
    cells = defaultdict(float)
    for *cell, n in rows:
        cells[tuple(cell)] += n
    total = sum(cells.values())
    want = []
    for k in range(3):
        share = defaultdict(float)
        for cell, n in cells.items():
            share[cell[k]] += n
        powered = {c: n ** alpha for c, n in share.items()}
        want.append({c: budget * total * x / sum(powered.values()) for c, x in powered.items()})
    p = dict.fromkeys(cells, budget)
    for _ in range(200):
        for k in range(3):
            now = defaultdict(float)
            for cell, n in cells.items():
                now[cell[k]] += n * p[cell]
            p = {cell: min(1.0, x * want[k][cell[k]] / now[cell[k]]) for cell, x in p.items()}
    return p


def test_pipeline_against_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    kept = {d for d, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op10_quality_cascade']})").fetchall() if k}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    items = [t for t, in con.execute(f"SELECT text FROM '{SF001}/benchmark.parquet'").fetchall()]
    one = brute_near_duplicates([(d, texts[d]) for d in sorted(kept)])
    clean = one - brute_leaks([(d, texts[d]) for d in one], items)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter(F.col("doc_id").isin(sorted(clean)))
    rows = docs.select("doc_id", *mixture_raking._described(docs, "text", "source", "lang", None),
                       mixture_raking._draw("doc_id", "text", 42).alias("u")).collect()
    p = brute_raking([(r["source"], r["lang"], r["topic"], r["tokens"]) for r in rows])
    drawn = {r["doc_id"] for r in rows if r["u"] < p[r["source"], r["lang"], r["topic"]]}
    got = corpus_pipeline.run(spark, SF001).collect()
    assert len(kept) > len(one) >= len(clean) > len(drawn) > 0
    assert sorted(r["doc_id"] for r in got) == sorted(drawn)
    # the smallest capacity that takes the groups in their order into 16 shards
    groups = defaultdict(int)
    for r in got:
        assert r["text"] == texts[r["doc_id"]]
        groups[r["shard"], r["shard_key"]] += len(r["text"].encode()) + 1
    sizes = defaultdict(int)
    for (s, _), n in groups.items():
        sizes[s] += n
    assert set(sizes) == set(range(16)) and len({k for _, k in groups}) == len(groups)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) <= max(mean + max(groups.values()), max(groups.values()))


def test_stages_keep_columns_and_take_clashing_names(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.lit(7) for n in NAMES})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            assert {tuple(r)[5:] for r in out.collect()} <= {(7,) * len(NAMES)}
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert set(docs.columns) <= set(last.columns) and last.count() == docs.count()


def test_free_names(spark):
    df = spark.range(1).selectExpr("id AS a", "id AS A_", "id AS b")
    assert free_names(df, "a", "c", "c", "B") == ["a__", "c", "c_", "B_"]


def test_null_path_inherits_nothing(spark):
    rows = [(1, "LICENSE", license_cosine.TEMPLATES["MIT"]), (2, None, "no notice"), (3, "x.py", "no notice")]
    got = crossed(license_cosine.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect(), "doc_id")
    assert (got[2]["license"], got[2]["origin"]) == (None, "none")
    assert (got[3]["license"], got[3]["origin"]) == ("MIT", "inherited")


def test_numeric_signs_are_no_letters(spark):
    rows = [(1, "½ ² ① Ⅷ 12 _", "en"), (2, "the words of the text", "en"), (3, "die worte des textes", "de"), (4, "²the½", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = crossed(language_mixture.identify_languages(docs, F.lit(False)).collect(), "doc_id")
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0)
    assert all(got[d]["lang_pred"] != "und" for d in (2, 3, 4))


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" + " " * 1_000_000, "0" + " " * 1_000_000, "(" * 1_000_000, "0(" * 500_000,
                                  "a." * 500_000, "0 " * 500_000, "-" * 1_000_000, "ab+" * 300_000],
                         ids=["letters", "spaces", "zero-spaces", "brackets", "zero-brackets", "dots", "zeros", "dashes", "pluses"])
def test_long_runs_are_scanned_in_linear_time(text):
    start = time.process_time()
    for _ in re.finditer(feistel_pii._PATTERN, text):
        pass
    assert time.process_time() - start < 5


def test_social_security_numbers_are_valid_and_stay_valid():
    find = lambda t: [m[0] for m in feistel_pii._PATTERN.finditer(t) if m["ssn"]]
    assert find("000-12-3456, 666-12-3456, 900-12-3456, 123-00-4567, 123-45-0000, 123-45-6789") == ["123-45-6789"]
    rng, seen = random.Random(1), {}
    for _ in range(500):
        v = f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 600)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"
        new = feistel_pii._ssn(v, feistel_pii.KEY)
        assert find(new) == [new]
        assert seen.setdefault(new, v) == v


def test_string_tiling_of_periodic_texts_ends():
    a = [i % 2 for i in range(300)]
    tiles = string_tiling.greedy_tiles(a, a, 5)
    assert sum(t[0] for t in tiles) >= 295 and np.all([t[0] >= 5 for t in tiles])
