"""Scoring and analysis queries that SQL can follow: a published model in place of a trained one.

Three quantiles of ``l_extendedprice``, two trees each, written as the tables
that ``ModelSet.save`` writes and read back by run id; SQL states the same
trees as ``CASE``.  One leaf of p90 lies below p50 and p90 falls with the
discount, so that the two checks have something to find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as V
from ..operators import runs as M
from ..operators import score as S
from ..operators.forecast import QuantileForecaster, best_round
from ..operators.gbt.model import ModelSet, QuantileModel
from ..operators.gbt.trees import Tree
from ..functions.columns import mixed_date
from .io_queries import _scratch
from .model_queries import KEY, QUANTILES, _VALIDATE_SQL, _dirty, demo_config, joined
from .registry import load, query

TARGET = "l_extendedprice"
LABELS = [f"{TARGET}_p{int(q * 100)}" for q in QUANTILES]
#: per quantile: base; leaves of tree 0 (few items; many and urgent; many); of tree 1 (small discount and under 10 items;
#: small discount; large discount).  Whole numbers, so that sums are exact.
LEAVES = {0.1: (10_000, (-4_000, 9_000, 8_000), (-1_500, 500, 1_000)),
          0.5: (30_000, (-12_000, 15_000, 14_000), (-2_000, 0, 800)),
          0.9: (60_000, (-41_500, 12_000, 25_000), (-5_000, 1_500, -3_000))}
FEATURES = ["l_quantity", "l_discount", "l_tax", "o_orderpriority_Enc"]
CUTS = [[10.0, 24.5], [0.055], [0.04], [2.0]]


def _tree(first: tuple, inner: tuple, inner_left: bool, leaves: tuple) -> Tree:
    """Two splits, each ``(feature, bin)``; the second one in the left or right child of the first."""
    t, free = Tree(), ((float("-inf"), float("inf")),) * 2
    t.add_children(0, *first, True, 1.0, *free, 1.0, 1.0)
    t.add_children(1 if inner_left else 2, *inner, True, 1.0, *free, 1.0, 1.0)
    for node, value in zip((3, 4, 2) if inner_left else (1, 3, 4), leaves):
        t.value[node] = float(value)
    return t


def published(spark, sf) -> QuantileForecaster:
    models = ModelSet(list(FEATURES), [list(c) for c in CUTS], [1, 0, 0, 0])
    for q, (base, many, discount) in LEAVES.items():
        trees = [_tree((0, 2), (3, 1), False, many), _tree((1, 1), (0, 1), True, discount)]
        models.models.append(QuantileModel(f"{TARGET}_p{int(q * 100)}", TARGET, q, float(base), trees, 2, 0.0))
    path = _scratch(spark, "published")
    models.save(spark, path, "published")
    fc = QuantileForecaster(demo_config())
    fc.fit_encoders(fc.prepare(joined(spark, sf), False))
    fc.model_set = ModelSet.load(spark, path, "published")
    return fc


def _case_sql(q: float) -> str:
    base, (few, urgent, many), (tiny, small, large) = LEAVES[q]
    return (f"CAST({base} + CASE WHEN coalesce(qty, 0) < 24.5 THEN {few} WHEN level < 2 THEN {urgent} ELSE {many} END"
            f" + CASE WHEN coalesce(l_discount, 0) >= 0.055 THEN {large} WHEN coalesce(qty, 0) < 10 THEN {tiny} ELSE {small} END"
            " AS DOUBLE)")


def _scored_sql(source: str = "SELECT *, l_quantity AS qty, o_orderpriority AS pr FROM lineitem JOIN orders ON l_orderkey = o_orderkey") -> str:
    level = "CASE pr WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE -1 END"
    cases = ", ".join(f"{_case_sql(q)} AS {label}" for q, label in zip(QUANTILES, LABELS))
    return f"WITH src AS ({source}), lv AS (SELECT *, {level} AS level FROM src), scored AS (SELECT *, {cases} FROM lv)\n"


_KEYS = ", ".join(KEY)
_ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LONG = " UNION ALL ".join(f"SELECT *, CAST({q} AS DOUBLE) AS quantile, {label} AS prediction FROM scored"
                           for q, label in zip(QUANTILES, LABELS))


@query("published_predict_long", oracle=_scored_sql() + f"""
SELECT {_KEYS}, '{TARGET}' AS target, quantile, prediction FROM ({_LONG})
""")
def published_predict_long(spark, sf):
    """Every row and quantile, by a model read back from its tables."""
    return published(spark, sf).predict(joined(spark, sf), "long", keep=KEY)


@query("published_predict_wide", oracle=_scored_sql() + f"SELECT {_KEYS}, {', '.join(LABELS)} FROM scored")
def published_predict_wide(spark, sf):
    """A column per quantile."""
    return published(spark, sf).predict(joined(spark, sf), "wide", keep=KEY)


@query("published_pinball", oracle=_scored_sql() + f"""
SELECT '{TARGET}' AS target, quantile, count(*) AS n, round(avg(CASE WHEN {TARGET} >= prediction
    THEN quantile * ({TARGET} - prediction) ELSE (1 - quantile) * (prediction - {TARGET}) END), 4) AS pinball_loss
FROM ({_LONG}) GROUP BY quantile
""")
def published_pinball(spark, sf):
    """V3: mean pinball loss per quantile over all rows."""
    pred = published(spark, sf).predict(joined(spark, sf), "long", keep=[TARGET])
    return V.pinball_loss(pred, TARGET).withColumn("pinball_loss", F.round("pinball_loss", 4))


@query("published_crossings", oracle=_scored_sql() + f"""
SELECT count(*) FILTER (WHERE {LABELS[0]} > {LABELS[1]} OR {LABELS[1]} > {LABELS[2]}) AS crossings, count(*) AS "rows" FROM scored
""")
def published_crossings(spark, sf):
    """V4: rows whose quantiles are out of order."""
    return V.quantile_crossings(published_predict_wide(spark, sf), LABELS)


@query("published_monotonicity", oracle=_scored_sql() + f"""
, each AS (SELECT quantile, l_quantity, l_tax, o_orderpriority, l_discount, min(prediction) AS mn, max(prediction) AS mx
           FROM ({_LONG}) GROUP BY ALL),
 steps AS (SELECT quantile, lag(mx) OVER (PARTITION BY quantile, l_quantity, l_tax, o_orderpriority ORDER BY l_discount) - mn AS fall FROM each)
SELECT '{TARGET}' AS target, quantile, count(*) FILTER (WHERE fall > 0) AS violations, count(*) AS checked FROM steps GROUP BY quantile
""")
def published_monotonicity(spark, sf):
    """V4: drops of the prediction as the discount grows, all other inputs equal."""
    long = published(spark, sf).predict(joined(spark, sf), "long", keep=["l_quantity", "l_discount", "l_tax", "o_orderpriority"])
    return V.monotonicity_violations(long, "l_discount", ["target", "quantile", "l_quantity", "l_tax", "o_orderpriority"])


def _by_row(spark, sf):
    rows = joined(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))
    return published(spark, sf).predict(rows, "wide", keep=["row_id"])


@query("published_format", oracle=_scored_sql() + f"""
SELECT {_ROW_ID} AS row_id, '{TARGET}' AS Component, {', '.join(f'{x} AS {x.rsplit("_", 1)[1]}' for x in LABELS)} FROM scored
""")
def published_format(spark, sf):
    """One row per row and target, a column per quantile."""
    return S.format_predictions_wide(_by_row(spark, sf), "row_id", [TARGET], QUANTILES)


@query("published_curve", oracle=_scored_sql() + " UNION ALL ".join(
    f"SELECT {_ROW_ID} AS row_id, '{x.rsplit('_', 1)[1]}' AS Quantile, {x} AS {TARGET} FROM scored" for x in LABELS))
def published_curve(spark, sf):
    """One row per row and quantile, a column per target."""
    return S.quantile_curve_wide(_by_row(spark, sf), "row_id", [TARGET], QUANTILES)


_DIRTY_SQL = _scored_sql("SELECT * REPLACE (TRY_CAST(qty AS DOUBLE) AS qty) FROM e")


@query("published_predict_batch", oracle=_VALIDATE_SQL.rstrip() + ", " + _DIRTY_SQL.removeprefix("WITH ") + f"""
SELECT {_ROW_ID} AS row_id, CAST(CASE WHEN e1 IS NULL AND e2 IS NULL THEN 200 ELSE 400 END AS INTEGER) AS status_code,
       CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL THEN 'Invalid input features: ' || concat_ws('; ', e1, e2) END AS error,
       {', '.join(f'CASE WHEN e1 IS NULL AND e2 IS NULL THEN {x} END AS {x.rsplit("_", 1)[1]}' for x in LABELS)}
FROM scored
""")
def published_predict_batch(spark, sf):
    """Status, errors and predictions of a batch with bad rows; a bad row has none of its own."""
    fc = published(spark, sf)
    dirty = _dirty(spark, sf).withColumn("row_id", F.concat_ws("-", *KEY))
    out = S.predict_batch(dirty, S.ModelSchema.from_config(fc.cfg), lambda d: fc.predict(d, "wide"), "row_id")
    return out.select("row_id", "status_code", "error", *[
        F.try_element_at(F.try_element_at("predictions", F.lit(TARGET)), F.lit(p)).alias(p) for p in ("p10", "p50", "p90")])


@query("best_rounds", oracle="""
WITH curve AS (SELECT event_type, user_id % 50 + 1 AS round, min(value) AS loss FROM events GROUP BY ALL),
 least AS (SELECT event_type, min(loss) AS loss FROM curve GROUP BY event_type)
SELECT event_type AS model, CAST(min(round) AS INTEGER) AS best_round, loss AS best_score
FROM curve JOIN least USING (event_type, loss) GROUP BY event_type, loss
""")
def best_rounds(spark, sf):
    """T-8: first round of the smallest loss, on a curve of losses per event type."""
    curve = load(spark, sf, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 50 + 1).cast("int").alias("round")) \
        .agg(F.min("value").alias("test_quantile_mean"))
    return best_round(curve)


_GAINS_SQL = """WITH gains AS (SELECT l_returnflag AS run_id, l_linestatus AS model, 'line ' || l_linenumber AS Feature,
    round(avg(l_quantity), 6) AS Gain, count(*) AS splits FROM lineitem GROUP BY ALL)
"""


def _gains(spark, sf):
    """Split gains of many trees: flags as runs and models, line numbers as features, quantities (whole) as gains."""
    li = load(spark, sf, "lineitem")
    trees = li.select(F.col("l_returnflag").alias("run_id"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("feature"),
                      F.col("l_quantity").alias("gain"))
    names = trees.select("run_id", "feature").distinct().withColumn("name", F.concat(F.lit("line "), F.col("feature").cast("string")))
    return V.feature_importance(trees, names).withColumn("Gain", F.round("Gain", 6))


@query("split_gains", oracle=_GAINS_SQL + "SELECT * FROM gains")
def split_gains(spark, sf):
    """V1: mean gain and number of splits per run, model and feature."""
    return _gains(spark, sf)


@query("top_split_gains", oracle=_GAINS_SQL + """, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, model ORDER BY Gain DESC, Feature) AS INTEGER) AS rank FROM gains)
SELECT * FROM ranked WHERE rank <= 3
""")
def top_split_gains(spark, sf):
    """V2: the three features of the largest gain of every model."""
    return V.top_features(_gains(spark, sf), 3)


_DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss"]


@query("parse_dates", oracle="""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def parse_dates(spark, sf):
    """Order dates written in five formats, or not as a date at all, parsed again."""
    k = F.col("o_orderkey") % 6
    text = F.lit("no date")
    for i, fmt in enumerate(_DATE_FORMATS):
        text = F.when(k == i, F.concat(F.lit(" "), F.date_format("o_orderdate", fmt))).otherwise(text)
    rows = load(spark, sf, "orders").select("o_orderkey", text.alias("written"))
    return rows.select("o_orderkey", mixed_date("written").cast("date").alias("day"))


@query("run_records", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS status, o_orderpriority AS experiment
FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)
""")
def run_records(spark, sf):
    """M9: run records as JSON lines; broken lines and records without an id are skipped."""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey") % 10
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("status"),
                                F.col("o_orderpriority").alias("experiment")))
    lines = F.when(k == 3, F.substring(record, 1, 15)).when(k == 7, F.lit('{"status": "F"}')).otherwise(record)
    path = _scratch(spark, "records")
    o.select(lines.alias("value")).write.text(path)
    return M.read_run_records(spark, path).select("run_id", "status", "experiment")
