"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule says when a document *fails*.  Cost (seconds on a sample) and
selectivity (share of the sample that fails) of every rule are measured
first; the rules then run as one ``CASE WHEN`` in order of rejections per
second, so that a document stops at the first rule it fails.  The order
changes the work, never the verdict.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are judged one by one; an empty table gives an empty result;
columns other than the text are never read by a rule, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words

#: Rows of the sample on which rules are timed (a bound, not a filter of the result).
SAMPLE_ROWS = 2000

BASE_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lines(text: Column) -> Column:
    """Lines (split at newline) that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Windows are compared by a 64-bit hash of their words.  Without any
    repeated window the answer is known from one hash-set pass; otherwise
    windows are sorted by hash and each neighbour run marks its positions.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        repeated = let(pairs, lambda s: F.transform(
            F.filter(s, lambda x, k: (x["h"].eqNullSafe(F.get(s, k - 1)["h"]))
                     | (x["h"].eqNullSafe(F.get(s, k + 1)["h"]))), lambda x: x["p"]))
        return let(F.sort_array(repeated), lambda d: F.aggregate(
            F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3)))),
            F.lit(0), lambda acc, x: acc + x))

    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(
        hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
        .otherwise(covered(h))))


#: Feature name -> expression over (text, words); all are long and never null.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")),
    "n_symbols": lambda t, w: F.size(F.split(t, "[#*$%&|<>]")) - 1,
    "n_lines": lambda t, w: F.size(_lines(t)),
    "n_dup_lines": lambda t, w: _dup_lines(t),
    "n_repeat_words": lambda t, w: _repeat_words(w),
    "n_letter_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
}


@dataclass(frozen=True)
class Rule:
    """``fails`` maps a feature accessor to a boolean that is never null."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f("n_words") < 50),
    Rule("repeated_windows", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("duplicate_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words"))
         | (f("word_chars") > 20 * f("n_words"))),
    Rule("letters", lambda f: 100 * f("n_letter_words") < 70 * f("n_words")),
)


def _accessor(text: Column, w: Column, known: Column | None = None) -> Callable[[str], Column]:
    def get(name: str) -> Column:
        if known is not None and name in BASE_FEATURES:
            return known[name]
        return FEATURES[name](text, w).cast("long")
    return get


def _verdict(rules: list[Rule], get: Callable[[str], Column]) -> Column:
    """False at the first rule that fails; later rules are not evaluated."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(rule.fails(get), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _fails(rule: Rule, text: Column) -> Column:
    return let(words(text), lambda w: rule.fails(_accessor(text, w)))


def rank_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
               sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Rules by rejections per second on a sample of about ``sample_rows`` rows.

    Returns ``{"rule", "cost", "selectivity"}`` in the order to run them.
    """
    rows = docs.count()
    if not rows:
        return [{"rule": r, "cost": 0.0, "selectivity": 0.0} for r in rules]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    sample = materialize(docs.select(text).sample(min(1.0, sample_rows / rows), seed).coalesce(1))
    measured = []
    for rule in (None, *rules):
        failed = F.lit(False) if rule is None else _fails(rule, F.col("t"))
        began = time.perf_counter()
        n, k = sample.agg(F.count(F.lit(1)), F.count_if(failed)).first()
        measured.append((rule, time.perf_counter() - began, k / max(n, 1)))
    base = measured[0][1]
    ranked = [{"rule": r, "cost": max(s - base, 1e-3), "selectivity": k} for r, s, k in measured[1:]]
    return sorted(ranked, key=lambda m: -m["selectivity"] / m["cost"])


def quality_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: id, the base features, ``base_failed`` and ``kept``."""
    order = [m["rule"] for m in rank_rules(docs, text_col, rules, sample_rows)]
    text = F.col("__t")

    def judged(w: Column) -> Column:
        base = F.struct(*[FEATURES[n](text, w).cast("long").alias(n) for n in BASE_FEATURES])
        return let(base, lambda f: F.struct(
            f.alias("f"),
            F.when(BASE_RULES[0].fails(_accessor(text, w, f)), F.lit(True))
            .otherwise(BASE_RULES[1].fails(_accessor(text, w, f))).alias("base_failed"),
            _verdict(order, _accessor(text, w, f)).alias("kept")))

    out = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    out = out.select(id_col, let(words(text), judged).alias("__q"))
    return out.select(id_col, *[F.col(f"__q.f.{n}").alias(n) for n in BASE_FEATURES],
                      F.col("__q.base_failed").alias("base_failed"),
                      (F.col("__q.kept") & ~F.col("__q.base_failed")).alias("kept"))


def keep_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns unchanged."""
    order = [m["rule"] for m in rank_rules(docs, text_col, rules, sample_rows)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(let(text, lambda t: let(
        words(t), lambda w: _verdict(order, _accessor(t, w)))))
