"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention_lm import score_documents
from .best_position import search_documents
from .common import prepare, table
from .feistel_pii import pseudonymize
from .language_mixture import identify_languages
from .license_cosine import derived_path, scan_licenses
from .minimax_shards import shard_frame
from .mixture_raking import mixture_frame
from .quality_cascade import quality_frame
from .signature_trees import jaccard_components
from .simhash_bktree import hex_fingerprint, simhash_components
from .string_tiling import leaked_pairs
from .token_alignment import align_tokenizers
from .window_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run
    return wrap


@query("op1_greedy_string_tiling")
def op1(spark, sf_dir):
    """(document, benchmark item) pairs whose tiles cover 0.8 of the item's words."""
    pairs = leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def _remainder(n: int):
    """crc32 of the id's text modulo ``n`` is 1; a null id counts as not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == 1, F.lit(False))


@query("op2_language_mixture")
def op2(spark, sf_dir):
    """Language of every text by a mixture over its words."""
    return identify_languages(table(spark, sf_dir, "documents"), _remainder(3))


@query("op3_license_cosine")
def op3(spark, sf_dir):
    """Licence of every document, from its own text or its directories."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs.withColumn("path", derived_path(F.col("doc_id"))))


@query("op4_attention_lm")
def op4(spark, sf_dir):
    """Base and attention-model log probability of every text."""
    return score_documents(table(spark, sf_dir, "documents"), _remainder(5))


@query("op5_simhash_bktree")
def op5(spark, sf_dir):
    """SimHash fingerprints and components at two bits."""
    comp = simhash_components(table(spark, sf_dir, "documents"))
    return comp.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


@query("op6_minimax_shards")
def op6(spark, sf_dir):
    """Sixteen shards of near-equal bytes; equal texts share one."""
    return shard_frame(table(spark, sf_dir, "documents"))


@query("op7_feistel_pii")
def op7(spark, sf_dir):
    """Texts with format-preserving pseudonyms."""
    return pseudonymize(table(spark, sf_dir, "documents"))


@query("op8_window_doubling")
def op8(spark, sf_dir):
    """Words left when windows of 35 words that occur twice are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op9_mixture_raking")
def op9(spark, sf_dir):
    """Probability and draw of each document for tempered source, language and topic shares."""
    return mixture_frame(table(spark, sf_dir, "documents"))


@query("op10_quality_cascade", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, t, w, ls,
             list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n
      FROM (SELECT doc_id, unnest(g) AS s, generate_subscripts(g, 1) AS i FROM g)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x WHERE n > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
             len(array_to_string(w.w, ''))::BIGINT AS word_chars,
             (len(w.t) - len(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(w.ls) - len(list_distinct(w.ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w.ls) AS n_lines,
             len(list_filter(w.w, lambda q: regexp_matches(q, '\pL'))) AS n_letter_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * n_letter_words < 70 * n_words) AS kept
FROM f
""")
def op10(spark, sf_dir):
    """Base features and the cascade's verdict of each document."""
    return quality_frame(table(spark, sf_dir, "documents"))


@query("op11_best_position", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
d AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY r, term),
x AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // total AS m FROM d, c),
s AS (SELECT q.i, q.item_id, m.r, m.doc_id, sum(x.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN p ON p.term = q.term JOIN x ON x.term = q.term JOIN m ON m.r = p.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
""")
def op11(spark, sf_dir):
    """The ten best documents of each benchmark item by impact lists and best positions."""
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_shared_cuts")
def op12(spark, sf_dir):
    """Groups of both tokenizers' tokens between shared cuts and the corpus counts of linked ids."""
    return align_tokenizers(table(spark, sf_dir, "documents"), digest=True)


@query("op13_signature_trees", r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
g AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
             END AS g FROM t),
-- equal sets are one vertex
k AS MATERIALIZED (SELECT r, doc_id, len(g)::BIGINT AS n, g, dense_rank() OVER (ORDER BY list_sort(g)) AS v FROM g),
s AS MATERIALIZED (SELECT v, n, unnest(g) AS x FROM (SELECT DISTINCT ON (v) v, n, g FROM k)),
m AS MATERIALIZED (SELECT v, n, x FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM s) WHERE c > 1),
e AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM m a JOIN m b ON a.x = b.x AND a.v <> b.v
                   AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.v, b.v, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
c AS (SELECT DISTINCT v AS v, v AS u FROM k WHERE n > 0 UNION SELECT c.v, e.b FROM c JOIN e ON e.a = c.u),
l AS (SELECT v, min(doc_id) AS least FROM k GROUP BY v),
o AS (SELECT c.v, min(l.least) AS component FROM c JOIN l ON l.v = c.u GROUP BY c.v)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE o.component END AS component_id
FROM k LEFT JOIN o ON o.v = k.v
""")
def op13(spark, sf_dir):
    """Components of documents whose sets of four-word shingles have 85 % of their union in common."""
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
