"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per (source, language, topic) cell.  The inclusion
probabilities of the cells start at the token budget's share of the corpus
and are raked in turn to the source, language and topic marginals: every
cell of a category is multiplied by target / current expected tokens, and
held to at most 1.  Documents are then drawn by comparing a hash of id and
text with their cell's probability, so a draw is repeatable and needs no
shuffle of texts.

The cells, not the documents, pass through the driver, and only while there
are at most ``driver_cells`` of them; beyond that the same steps run as
DataFrame aggregations, a written table per sweep.

Defined cases: a null category is the category ``(null)``; a null or empty
text has no words and counts as one token, so that it belongs to a cell with
weight; rows with equal id and text are drawn alike; targets without tokens
are ignored and the others rescaled; a category that explicit targets leave
out has share zero; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, unsigned_unit, words

MARGINS = ("source", "lang", "topic")
DRIVER_CELLS = 50_000
#: Topic name -> pattern found in the text; the first that matches names it, else "prose".
TOPICS = {"legal": r"(?i)licen[cs]ed? ", "contact": r"@|\+\d", "tabular": r" \| ", "markup": r"[#*$%&]{3}"}


def topic_of(text: Column, topics: dict[str, str] = TOPICS, default: str = "prose") -> Column:
    out = F.lit(default)
    for name, pattern in reversed(topics.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _described(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> list[Column]:
    """source, lang, topic, tokens and the uniform draw of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    return [name(F.col(source_col)).alias("source"), name(F.col(lang_col)).alias("lang"),
            name(topic_of(text) if topic is None else topic).alias("topic"),
            F.greatest(F.size(words(text)), F.lit(1)).cast("long").alias("tokens")]


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    return unsigned_unit(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))


def tempered_targets(cells: DataFrame, alpha: float = 0.5) -> dict[str, dict[str, float]]:
    """Target shares of each margin: token shares to the power ``alpha``, rescaled."""
    out = {}
    for m in MARGINS:
        share = {r[0]: float(r[1]) ** alpha for r in cells.groupBy(m).agg(F.sum("tokens")).collect()}
        whole = sum(share.values()) or 1.0
        out[m] = {k: v / whole for k, v in share.items()}
    return out


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float,
         tol: float = 1e-6, sweeps: int = 200) -> np.ndarray:
    """Inclusion probability of each cell (see the module text)."""
    p = np.full(len(tokens), budget)
    whole = budget * tokens.sum()
    for _ in range(sweeps):
        before = p.copy()
        for code, share in zip(codes, targets):
            now = np.bincount(code, tokens * p, len(share))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(now > 0, share * whole / now, 1.0)
            p = np.minimum(1.0, p * factor[code])
        if np.abs(p - before).max(initial=0) < tol:
            break
    return p


def _rake_cells(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float,
                sweeps: int, tol: float) -> DataFrame:
    """The same sweeps over a cell table of any size."""
    spark = cells.sparkSession
    goals = {m: spark.createDataFrame(list(targets[m].items()), f"{m} string, share double") for m in MARGINS}
    whole = cells.agg(F.sum("tokens")).first()[0] * budget
    cells = cells.withColumn("p", F.lit(budget))
    for _ in range(sweeps):
        step = cells.withColumn("old", F.col("p"))
        for m in MARGINS:
            now = step.groupBy(m).agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
            factor = now.join(goals[m], m, "left").select(m, F.when(
                F.col("now") > 0, F.coalesce("share", F.lit(0.0)) * whole / F.col("now")).otherwise(1.0).alias("factor"))
            step = step.join(factor, m, "left").withColumn(
                "p", F.least(F.lit(1.0), F.col("p") * F.coalesce("factor", F.lit(1.0)))).drop("factor")
        step = materialize(step)
        moved = step.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0]
        cells = step.drop("old")
        if moved is None or moved < tol:
            break
    return cells


def calibrate(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = 0.5,
              alpha: float = 0.5, tol: float = 1e-6, sweeps: int = 200,
              driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """``cells(source, lang, topic, tokens)`` with their probability ``p``; whether they are few."""
    present = {m: {r[0] for r in cells.select(m).distinct().collect()} for m in MARGINS} if targets else {}
    targets = {m: {k: v for k, v in targets[m].items() if k in present[m]} for m in MARGINS} if targets \
        else tempered_targets(cells, alpha)
    targets = {m: {k: v / (sum(t.values()) or 1.0) for k, v in t.items()} for m, t in targets.items()}
    few = cells.count() <= driver_cells
    if not few:
        return _rake_cells(cells, targets, budget, sweeps, tol), False
    rows = cells.select(*MARGINS, "tokens").orderBy(*MARGINS).collect()
    names = [sorted({r[m] for r in rows}) for m in MARGINS]
    at = [{n: i for i, n in enumerate(own)} for own in names]
    codes = [np.array([a[r[m]] for r in rows], np.int64) for m, a in zip(MARGINS, at)]
    share = [np.array([targets[m].get(n, 0.0) for n in own]) for m, own in zip(MARGINS, names)]
    p = rake(np.array([r["tokens"] for r in rows], float), codes, share, budget, tol, sweeps)
    return cells.sparkSession.createDataFrame(
        [(*(r[m] for m in MARGINS), r["tokens"], float(x)) for r, x in zip(rows, p)],
        "source string, lang string, topic string, tokens bigint, p double"), True


def _cells(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))


def mixture_frame(docs: DataFrame, targets=None, budget: float = 0.5, alpha: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  topic: Column | None = None, seed: int = 42, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Per document: id, cell, tokens, ``probability`` and ``sampled``."""
    rows = materialize(docs.select(F.col(id_col).alias("__id"), *_described(docs, text_col, source_col, lang_col, topic),
                                   _draw(id_col, text_col, seed).alias("u")))
    fitted, few = calibrate(_cells(rows), targets, budget, alpha, driver_cells=driver_cells)
    fitted = fitted.drop("tokens")
    return rows.join(F.broadcast(fitted) if few else fitted, list(MARGINS)).select(
        F.col("__id").alias(id_col), *MARGINS, F.col("tokens").alias("n_tokens"),
        F.col("p").alias("probability"), (F.col("u") < F.col("p")).alias("sampled"))


def sample_mixture(docs: DataFrame, targets=None, budget: float = 0.5, alpha: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                   topic: Column | None = None, seed: int = 42, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled rows of ``docs``, all columns unchanged."""
    described = _described(docs, text_col, source_col, lang_col, topic)
    fitted, few = calibrate(_cells(docs.select(*described)), targets, budget, alpha, driver_cells=driver_cells)
    *own, p, u = free_names(docs, *MARGINS, "p", "u")
    fitted = fitted.select(*[F.col(m).alias(o) for m, o in zip(MARGINS, own)], F.col("p").alias(p))
    keyed = docs.select("*", *[c.alias(o) for c, o in zip(described, own)], _draw(id_col, text_col, seed).alias(u))
    kept = keyed.join(F.broadcast(fitted) if few else fitted, own).filter(F.col(u) < F.col(p))
    return kept.select(*docs.columns)
