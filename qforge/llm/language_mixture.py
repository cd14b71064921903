"""Language identification as a mixture over each document's words.

Every learned language has a character model: the probability of a byte
given the two before it, inside lower-cased words with their borders.  The
words of a document are drawn from a mixture of languages; expectation-
maximisation estimates the proportions, and the set of languages is chosen by
penalised likelihood: starting from the best single language, the language
that raises the likelihood most joins while the gain exceeds
``penalty * log(words)``.

The models are fitted on a sample of about ``per_language`` labelled
documents of each language (by a hash of id and text, so that it does not
depend on the partitioning); every prediction reads the whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0;
rows without a label teach nothing; without any label all is ``und``; ties
between languages go to the smaller name; repeated rows are predicted one by
one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unsigned_unit

#: Labelled documents per language on which the models are fitted (about).
PER_LANGUAGE = 2000
BUCKETS = 1 << 18
PENALTY, ROUNDS = 2.0, 12

#: Word characters that are no letters: numeric signs such as fractions and superscripts.
_NUMERIC = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())
_WORD = re.compile(rf"[^\W\d_{_NUMERIC}]+")
_RUN = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    """The matches of ``_WORD`` in the lower-cased text.

    Its class of over a thousand signs is slow to match: only runs that hold such a sign are matched with it.
    """
    runs = _RUN.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else _WORD.findall(run))]


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket, bigram, word start) of ``words``, borders included."""
    raw = [b" " + w.encode() + b" " for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    inside = np.ones(len(flat), bool)
    inside[start] = inside[start + 1] = False  # a trigram ends at its third byte
    third = np.flatnonzero(inside)
    pair = flat[third - 2] << np.uint32(8) | flat[third - 1]
    gram = (pair << np.uint32(8) | flat[third]) * np.uint32(2654435761)
    first = start - 2 * np.arange(len(raw))
    return (gram >> np.uint32(14)).astype(np.int64), pair.astype(np.int64), first


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: (language, bucket) for trigrams, (language, -1 - bigram) for bigrams."""
    for part in slices(batches, "t", 4 << 20):
        text: dict[str, list[str]] = {}
        for lang, t in zip(part.column("lang").to_pylist(), part.column("t").to_pylist()):
            text.setdefault(lang, []).extend(_words(t))
        for lang, words in text.items():
            if words:
                gram, pair, _ = _trigrams(words)
                for sign, values in ((1, gram), (-1, pair)):
                    key, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key)), pa.array(key if sign > 0 else -1 - key), pa.array(n)], ["lang", "k", "n"])


class LanguageModels:
    """Log probability of a trigram's last byte, per language."""

    def __init__(self, languages: list[str], counts: list[tuple[str, int, int]], smooth: float = 0.5):
        self.languages = sorted(languages)
        row = {name: i for i, name in enumerate(self.languages)}
        self.gram = np.zeros((BUCKETS, len(row)), np.float32)
        self.pair = np.zeros((1 << 16, len(row)), np.float32)
        for lang, key, n in counts:
            (self.gram if key >= 0 else self.pair)[key if key >= 0 else -1 - key, row[lang]] += n
        self.gram = np.log(self.gram + smooth)
        self.pair = np.log(self.pair + 256 * smooth)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        gram, pair, first = _trigrams(words)
        return np.add.reduceat(self.gram[gram] - self.pair[pair], first, axis=0, dtype=np.float64)


def fit_models(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModels:
    rows = docs.filter(train & F.col(lang_col).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    draw, share = unsigned_unit(F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col))), F.lit(0.0)
    for lang, n in totals.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(share)
    sample = rows.filter(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    counts = sample.mapInArrow(_count_rows, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    return LanguageModels(list(totals), [tuple(r) for r in counts.collect()])


def _mix(p: np.ndarray, pi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for one document: ``p`` words x languages; proportions and log-likelihood."""
    for _ in range(rounds):
        r = p * pi
        pi = (r / r.sum(1, keepdims=True)).mean(0)
    return pi, float(np.log(p @ pi).sum())


def choose_mixture(logp: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of one document from word log-likelihoods."""
    top = logp.max(1, keepdims=True)
    p = np.exp(np.maximum(logp - top, -50.0))
    chosen = [int(np.argmax(logp.sum(0)))]
    best, pi = float(np.log(p[:, chosen[0]]).sum()), np.ones(1)
    price = penalty * np.log(len(p) + 1.0)
    while len(chosen) < p.shape[1]:
        tried = []
        for extra in sorted(set(range(p.shape[1])) - set(chosen)):
            trial = [*chosen, extra]
            tried.append((*_mix(p[:, trial], np.full(len(trial), 1.0 / len(trial))), trial))
        step = max(tried, key=lambda x: x[1])
        if step[1] - best <= price:
            break
        pi, best, chosen = step
    out = np.zeros(p.shape[1])
    out[chosen] = pi
    return out


def mixtures(logp: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of many documents; ``first``: where each one's words start."""
    size = np.diff(np.r_[first, len(logp)])
    single = np.add.reduceat(logp, first, axis=0)
    best = single.argmax(1)
    p = np.exp(np.maximum(logp - logp.max(1, keepdims=True), -50.0))
    # no set of languages explains a word better than its best language does
    bound = np.add.reduceat(logp.max(1), first) - single[np.arange(len(best)), best]
    # and the full mixture bounds every other one from above: EM once for all documents that could change
    out = np.zeros((len(best), logp.shape[1]))
    out[np.arange(len(best)), best] = 1.0
    price = penalty * np.log(size + 1.0)
    open_docs = np.flatnonzero(bound > price)
    if len(open_docs) and logp.shape[1] > 1:
        mine = np.repeat(np.isin(np.arange(len(best)), open_docs), size)
        q, n = p[mine], size[open_docs]
        at = np.cumsum(n) - n
        pi = np.full((len(n), q.shape[1]), 1.0 / q.shape[1])
        for _ in range(ROUNDS):
            r = q * np.repeat(pi, n, axis=0)
            pi = np.add.reduceat(r / r.sum(1, keepdims=True), at, axis=0) / n[:, None]
        full = np.add.reduceat(np.log((q * np.repeat(pi, n, axis=0)).sum(1)), at)
        alone = np.add.reduceat(np.log(q[np.arange(len(q)), np.repeat(best[open_docs], n)]), at)
        # EM stops short of the maximum: allow for what it may still gain
        for d in np.flatnonzero(full - alone > 0.9 * price[open_docs]):
            k = open_docs[d]
            out[k] = choose_mixture(logp[first[k]:first[k] + size[k]], penalty)
    return out


def _predict_rows(sent, penalty: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for part in slices(batches, "t", 2 << 20):
            seen: dict[str, int] = {}
            code: list[int] = []
            first, owner = [], []
            for i, t in enumerate(part.column("t").to_pylist()):
                words = _words(t)
                if words and models.languages:
                    first.append(len(code))
                    owner.append(i)
                    code.extend(seen.setdefault(w, len(seen)) for w in words)
            pred, score, mix = ["und"] * part.num_rows, [0.0] * part.num_rows, [""] * part.num_rows
            if owner:
                logp = models.words(list(seen))[np.array(code)]
                for i, pi in zip(owner, mixtures(logp, np.array(first), penalty)):
                    top = int(pi.argmax())
                    pred[i], score[i] = models.languages[top], float(min(pi[top], 1.0))
                    mix[i] = ",".join(f"{models.languages[j]}:{pi[j]:.3f}" for j in np.flatnonzero(pi))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(pred), pa.array(score), pa.array(mix)], names=names)
    return run


def predict_languages(docs: DataFrame, models: LanguageModels, held_out: Column, id_col: str = "doc_id",
                      text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Per document: id, held_out, lang_pred, score and the mixture as text."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = ["id", "held_out", "lang_pred", "score", "mixture"]
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_predict_rows(sent, penalty, names),
                           f"id {kind}, held_out boolean, lang_pred string, score double, mixture string").withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    models = fit_models(docs, ~held_out, id_col, text_col, lang_col, per_language)
    return predict_languages(docs, models, held_out, id_col, text_col)
