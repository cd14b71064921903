"""Tree grower: brute-force checks, invariants and partition invariance."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from qforge.operators.gbt import binning as BN
from qforge.operators.gbt import grower as GR
from qforge.operators.gbt import trees as TR
from qforge.operators.gbt.fit import _by_cells, cv_folds, fit_models, training_frame, with_row_keys
from qforge.operators.gbt.grower import Grower, GrowParams, make_specs
from qforge.operators.gbt.binning import n_bins
from qforge.operators.gbt.model import ModelSet, QuantileModel
from qforge.operators.gbt.trees import Tree


def test_best_split_matches_brute_force():
    rng = np.random.default_rng(0)
    G = rng.normal(size=(2, 6))
    H = rng.uniform(1, 3, size=(2, 6))
    G[:, 0] = 0.0
    H[:, 0] = 0.0
    G[1] = G[1] * 0 + G[0].sum() / 6  # second feature: same totals, flat
    H[1] = H[1] * 0 + H[0].sum() / 6
    G[1, 0], H[1, 0] = 0.0, 0.0
    G[1] *= G[0].sum() / G[1].sum()
    H[1] *= H[0].sum() / H[1].sum()
    sp = TR.best_split(G, H, np.ones(2, bool), np.zeros(2, int), -np.inf, np.inf, 1.0, 0.0, 0.0, 0.0)

    def score(g, h):
        return g * g / (h + 1.0)
    best = None
    for f in range(2):
        gt, ht = G[f].sum(), H[f].sum()
        for b in range(1, 5):
            gl, hl = G[f, 1:b + 1].sum(), H[f, 1:b + 1].sum()
            gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, b)
    assert (sp.feature, sp.split_bin) == (best[1], best[2])
    assert sp.gain == pytest.approx(best[0])


def test_monotone_projection():
    t = Tree()
    t.add_children(0, 0, 1, True, 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
    t.value[1], t.value[2] = 5.0, 1.0  # violates +1
    TR.project_monotone(t, np.array([1]))
    assert t.value[1] <= t.value[2]


def _weighted_quantile(r, w, q):
    order = np.argsort(r, kind="stable")
    cum = np.cumsum(w[order])
    return r[order][min(np.searchsorted(cum, q * cum[-1] * (1 - 1e-12)), len(r) - 1)]


def _leaf_grower(spark, rows, quantiles, scale, parts):
    frame = spark.createDataFrame(rows, "b int, _y0 double, _w double").repartition(5).select(
        F.unhex(F.lpad(F.hex("b"), 2, "0")).alias("_bins"), "_y0", "_w", F.lit(0).cast("long").alias("_fold"))
    specs = make_specs(1, quantiles, [GrowParams()], 0, 1)
    return Grower(frame, 1, 4, 1, [], specs, [scale], leaf_parts=parts), frame


@pytest.mark.parametrize("parts", [4096, 3])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_leaf_values_equal_brute_force(spark, scale, parts):
    """Every leaf, whatever the buckets of the first pass: many rows, equal rows, no weight, one row."""
    rng = np.random.default_rng(11)
    y = np.round(np.r_[rng.normal(1000.0, 250.0, 3000), np.full(400, 7.5), rng.normal(-3, 1e-9, 300), 4.0, 5.0], 12)
    w = np.round(np.r_[rng.uniform(0.5, 2.0, 3000), np.ones(400), rng.uniform(0.0, 2.0, 300), 0.0, 3.0], 3)
    b = np.r_[rng.integers(1, 3, 3000), np.full(700, 2), 3, 3]
    quantiles = [0.1, 0.5, 0.9]
    grower, frame = _leaf_grower(spark, [(int(k), float(v), float(x)) for k, v, x in zip(b, y, w)], quantiles, scale, parts)
    trees = {}
    for st in grower.models:
        t = trees[st.spec.model_id] = Tree()
        t.add_children(0, 0, 1, True, 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
        t.add_children(2, 0, 2, True, 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
    got = grower._leaf_values(frame, grower.models, trees, rnd=-1, with_pred=False)
    for st in grower.models:
        want = {node: _weighted_quantile(y[b == k], w[b == k], st.spec.quantile) for node, k in ((1, 1), (3, 2), (4, 3))}
        assert got[st.spec.model_id] == want


def _step_frame(spark, n=2000, parts=4):
    rows = [(i, float(i % 10), float((i * 7) % 13), (10.0 if i % 10 >= 5 else 0.0) + float((i * 31) % 17) / 17.0)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, z double, y double").repartition(parts)


def test_histogram_pass_equals_numpy(spark):
    df = _step_frame(spark, 600)
    frame, cuts, n, scales = training_frame(df, ["y"], ["x", "z"], None, ["id"], 1, 42, 32)
    specs = make_specs(1, [0.5], [GrowParams(max_depth=2)], 1, 3)
    g = Grower(frame, 2, n_bins(cuts), 1, [0, 0], specs, scales)
    g._base_scores(frame)
    base = g.models[0].base_score
    fr = frame.withColumn("_pred", F.lit(bytearray(np.asarray([base]).tobytes())).cast("binary"))
    hists, _ = g._level_pass(fr, g.models, 0, 0, False, {0: Tree()})
    H = hists[0][0]  # model 0, root node: (3, features, bins)
    pdf = df.toPandas()
    grad = np.where(base >= pdf.y.to_numpy(), 0.5, -0.5)
    for j, col in enumerate(["x", "z"]):
        b = np.searchsorted(cuts[j], pdf[col].to_numpy(), side="right") + 1
        ref = np.bincount(b, grad, minlength=H.shape[-1])
        assert np.allclose(H[0, j], ref)
        assert np.allclose(H[2, j], np.bincount(b, minlength=H.shape[-1]))
    ys = np.sort(pdf.y.to_numpy())
    m = len(ys) // 2
    assert ys[m - 1] - 1e-9 <= base <= ys[m] + 1e-9  # a weighted median of the labels


def _loss(pred, y, q):
    r = y - pred
    return np.mean(np.maximum(q * r, (q - 1) * r))


def test_quantile_models_learn_and_cover(spark):
    df = _step_frame(spark, 3000)
    res = fit_models(df, ["y"], ["x", "z"], [0.1, 0.5, 0.9], [1, 0], GrowParams(max_depth=3, eta=0.3),
                     nfold=3, num_boost_round=15, early_stopping_rounds=5, key_cols=["id"], max_bin=32)
    pred = res.model_set.predict(df, "long", keep=["id", "x", "y"]).toPandas()
    for q, g in pred.groupby("quantile"):
        const = np.quantile(g.y, q)
        assert _loss(g.prediction.to_numpy(), g.y.to_numpy(), q) < _loss(const, g.y.to_numpy(), q)
        cover = np.mean(g.y.to_numpy() <= g.prediction.to_numpy())
        assert abs(cover - q) < 0.08
    # monotone in x for every quantile
    grid = spark.createDataFrame([(0, float(x), 3.0, 0.0) for x in range(10)], "id long, x double, z double, y double")
    w = res.model_set.predict(grid, "wide").toPandas().sort_values("x")
    for c in [c for c in w.columns if c.startswith("y_p")]:
        assert (np.diff(w[c].to_numpy()) >= -1e-9).all()


def test_partition_invariance(spark):
    df1 = _step_frame(spark, 1500, parts=1)
    df7 = _step_frame(spark, 1500, parts=7)
    kw = dict(quantiles=[0.5], constraints=[0, 0], params=GrowParams(max_depth=2), nfold=3,
              num_boost_round=5, early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    a = fit_models(df1, ["y"], ["x", "z"], partitions=1, **kw)
    b = fit_models(df7, ["y"], ["x", "z"], partitions=7, **kw)
    pa_ = a.model_set.predict(df1, "long", keep=["id"]).orderBy("id").toPandas()
    pb_ = b.model_set.predict(df1, "long", keep=["id"]).orderBy("id").toPandas()
    assert np.allclose(pa_.prediction, pb_.prediction)


def test_weight_two_equals_duplicate(spark):
    base = [(i, float(i % 5), float(i % 3) + (i % 5)) for i in range(200)]
    dup = spark.createDataFrame(base + [(r[0] + 1000, r[1], r[2]) for r in base[:50]],
                                "id long, x double, y double").withColumn("w", F.lit(1.0))
    wtd = spark.createDataFrame([(r[0], r[1], r[2], 2.0 if r[0] < 50 else 1.0) for r in base],
                                "id long, x double, y double, w double")
    kw = dict(quantiles=[0.5], params=GrowParams(max_depth=2, min_child_weight=0.0), nfold=1,
              num_boost_round=3, early_stopping_rounds=None, max_bin=8, weight_col="w")
    a = fit_models(dup, ["y"], ["x"], key_cols=["id"], **kw)
    b = fit_models(wtd, ["y"], ["x"], key_cols=["id"], **kw)
    grid = spark.createDataFrame([(float(x),) for x in range(5)], "x double")
    pa_ = a.model_set.predict(grid, "long").orderBy("x").toPandas().prediction.to_numpy()
    pb_ = b.model_set.predict(grid, "long").orderBy("x").toPandas().prediction.to_numpy()
    assert np.allclose(pa_, pb_)


def test_sparse_histograms_equal_dense(spark, monkeypatch):
    from qforge.operators.gbt import grower as G
    df = _step_frame(spark, 800)
    kw = dict(quantiles=[0.5], constraints=[1, 0], params=GrowParams(max_depth=4), nfold=1,
              num_boost_round=3, early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    a = fit_models(df, ["y"], ["x", "z"], **kw)
    monkeypatch.setattr(G, "DENSE_CELLS", 8)
    b = fit_models(df, ["y"], ["x", "z"], **kw)
    pa_ = a.model_set.predict(df, "long", keep=["id"]).orderBy("id").toPandas().prediction
    pb_ = b.model_set.predict(df, "long", keep=["id"]).orderBy("id").toPandas().prediction
    assert np.allclose(pa_, pb_)


def test_checkpointed_rounds_match(spark):
    df = _step_frame(spark, 600)
    kw = dict(quantiles=[0.5], constraints=[0, 0], params=GrowParams(max_depth=2), nfold=1,
              num_boost_round=5, early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    a = fit_models(df, ["y"], ["x", "z"], checkpoint_interval=0, **kw)
    b = fit_models(df, ["y"], ["x", "z"], checkpoint_interval=2, **kw)
    pa_ = a.model_set.predict(df, "long", keep=["id"]).orderBy("id").toPandas().prediction
    pb_ = b.model_set.predict(df, "long", keep=["id"]).orderBy("id").toPandas().prediction
    assert np.allclose(pa_, pb_)


def test_degenerate_inputs(spark):
    rows = [(i, None, float(i % 3), 5.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, empty double, x double, y double")
    res = fit_models(df, ["y"], ["empty", "x"], [0.2, 0.8], [0, 0], GrowParams(max_depth=3), nfold=2,
                     num_boost_round=3, early_stopping_rounds=None, key_cols=["id"], max_bin=8)
    pred = res.model_set.predict(df, "long", keep=["id"]).toPandas()
    assert np.allclose(pred.prediction, 5.0)
    assert all(t.n_nodes == 1 for m in res.model_set.models for t in m.trees)


def test_folds_without_rows_leave_cv_to_the_others(spark):
    # keys that fall into two of five folds at most
    df = spark.createDataFrame([(i % 2, float(i % 2), float(i % 2)) for i in range(60)], "id long, x double, y double")
    res = fit_models(df, ["y"], ["x"], [0.5], [0], GrowParams(max_depth=2), nfold=5, num_boost_round=3,
                     early_stopping_rounds=2, key_cols=["id"], max_bin=8)
    assert len(res.best) == 1 and 1 <= res.best[0][4] <= 3
    assert res.cv.count() > 0


def test_expression_and_arrow_scoring_agree(spark):
    df = _step_frame(spark, 1000)
    res = fit_models(df, ["y"], ["x", "z"], [0.25, 0.75], [1, 0], GrowParams(max_depth=3), nfold=1,
                     num_boost_round=4, early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    probe = df.withColumn("x", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("x")))
    a = res.model_set.predict(probe, "long", keep=["id"], engine="expr").orderBy("id", "quantile").toPandas()
    b = res.model_set.predict(probe, "long", keep=["id"], engine="arrow").orderBy("id", "quantile").toPandas()
    assert np.allclose(a.prediction, b.prediction)


def test_more_than_a_few_split_nodes_are_scored_in_arrow(spark):
    """The expression of many nodes is one method that the JVM interprets."""
    rng, values = np.random.default_rng(7), [None, float("nan"), -1.0, 0.0, 2.5, 3.0, 9.0]
    trees = []
    for _ in range(10):
        tree = Tree()
        for depth in range(3):
            for node in list(tree.frontier(depth)):
                f = int(rng.integers(0, 2))
                tree.add_children(node, f, int(rng.integers(1, 5)), bool(rng.integers(0, 2)), 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
        for leaf in tree.leaves()[:5]:
            tree.value[leaf] = float(rng.normal())
        trees.append(tree)
    trees.append(Tree())  # no split
    cuts = [np.array([0.0, 2.0, 3.0, 4.0]), np.array([-1.0, 0.0, 1.0, 5.0])]
    models = ModelSet(["x", "z"], cuts, [0, 0], [QuantileModel("y_p50", "y", 0.5, 1.0, trees, 11, 0.0)])
    df = spark.createDataFrame([(i, x, z) for i, (x, z) in enumerate((x, z) for x in values for z in values)], "id long, x double, z double")
    found = models.predict(df, "wide", keep=["id"])
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "ArrowEvalPython" in plan
    expected = models.predict(df, "wide", keep=["id"], engine="expr")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    few = ModelSet(["x", "z"], cuts, [0, 0], [QuantileModel("y_p50", "y", 0.5, 1.0, trees[:1], 1, 0.0)]).predict(df, "wide")
    assert "ArrowEvalPython" not in few._sc._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "simple")


def test_keys_of_folds_are_told_apart_in_more_tasks_where_there_are_more_rows(spark, tmp_path, monkeypatch):
    from qforge.plans import model_queries
    rows = spark.range(600).select(*[(F.col("id") % k).cast("double").alias(c) for k, c in ((3, "l_quantity"), (2, "l_discount"), (1, "l_tax"))])
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(model_queries, "KEYS_PER_TASK", 50)
    out = model_queries.cv_folds_q(spark, str(tmp_path))
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert re.search(r"row_key#\d+L?, 12\), REPARTITION_BY_NUM", plan) and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert sorted(map(tuple, out.collect())) == [(float(x), float(d), 0.0, 100, 100, True) for x in range(3) for d in range(2)]


def test_copies_of_a_row_are_dealt_to_all_folds(spark):
    rows = spark.range(80_000).select((F.col("id") % 20).alias("x"), F.lit(1.5).alias("y"))
    for parts, chunk in ((1, 1 << 16), (7, 100)):
        dealt = cv_folds(rows.repartition(parts), 5)
        assert dealt.select("row_key").distinct().count() == dealt.count() == 80_000
        per = dealt.groupBy("x", "fold").count().collect()
        assert len(per) == 100 and all(abs(r["count"] - 800) < 160 for r in per)
        keys = {r[0] for r in with_row_keys(rows.repartition(parts), copies_per_task=chunk).select("row_key").collect()}
        assert len(keys) == 80_000
        first = keys if parts == 1 else first
        assert keys == first  # whatever the partitions and ranges


def test_hot_row_content_is_spread_over_partitions(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") < 45_000, 0).otherwise(F.col("id")).cast("double").alias("x"), F.lit(1.0).alias("y"))
    frame, _, n, _ = training_frame(rows, ["y"], ["x"], None, None, 5, 42, 32, partitions=8)
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert n == 50_000 and len(sizes) == 8 and max(sizes) < 1.1 * 50_000 / 8
    frame.unpersist()


@pytest.mark.parametrize("constraints,colsample", [([1, 0], 1.0), ([0, -1], 1.0), ([0, 0], 0.5)])
def test_splits_of_the_executors_equal_those_of_the_driver(spark, monkeypatch, constraints, colsample):
    df = _step_frame(spark, 1500)
    kw = dict(constraints=constraints, params=GrowParams(max_depth=4, colsample_bytree=colsample), nfold=2, num_boost_round=4,
              early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    want = fit_models(df, ["y"], ["x", "z"], [0.2, 0.7], **kw)
    monkeypatch.setattr(GR, "DRIVER_PARTIAL_CELLS", 0)
    got = fit_models(df, ["y"], ["x", "z"], [0.2, 0.7], **kw)
    for a, b in zip(want.model_set.models, got.model_set.models):
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
        assert [t.split_bin for t in a.trees] == [t.split_bin for t in b.trees]
        assert all(np.allclose(x.value, y.value) and np.allclose(x.cover, y.cover) for x, y in zip(a.trees, b.trees))
    assert np.allclose([r["test_quantile_mean"] for r in want.cv.orderBy("model", "round").collect()],
                       [r["test_quantile_mean"] for r in got.cv.orderBy("model", "round").collect()])


def _random_rows(n, values, seed=5):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, values, (n, 2)).astype(np.uint8)
    return (bins, rng.normal(100.0, 20.0, (n, 1)), rng.uniform(0.5, 2.0, n), rng.integers(0, 3, n),
            rng.integers(-1 << 62, 1 << 62, n))


@pytest.mark.parametrize("values", [4, 250])
@pytest.mark.parametrize("fold,sub", [(-1, 1.0), (1, 1.0), (2, 0.6)])
def test_sums_of_a_block_equal_those_of_its_rows(values, fold, sub):
    """Cells of many rows and of one: gradients, weights, counts and losses by bin vector."""
    bins, ys, w, of, rk = _random_rows(2000, values)
    block = GR.Block.of_rows(bins, ys, w, of, rk)
    code = block.bins[:, 0].astype(int) * 256 + block.bins[:, 1]
    assert len(np.unique(code)) == len(code) and block.rows.sum() == 2000
    block.preds = np.stack([np.zeros(len(code)), 95.0 + code % 11], axis=1)
    mine = bins[:, 0].astype(int) * 256 + bins[:, 1]
    pred, q = 95.0 + mine % 11, 0.3
    train = (of != fold) & ((TR.uniform01(rk, 77) < sub) if sub < 1.0 else True)
    got = block.gradients(0, q, fold, sub, 77, 1)
    for k, by_row in enumerate((np.where(pred >= ys[:, 0], 1 - q, -q) * w, w, np.ones(2000))):
        assert np.allclose(got[k], np.bincount(mine, by_row * train, 1 << 16)[code])
    loss = np.maximum(q * (ys[:, 0] - pred), (q - 1) * (ys[:, 0] - pred)) * w
    held = (of == fold) & (fold >= 0)
    assert np.allclose(block.losses(0, q, fold, 1), [[x[m].sum() for x in (loss, w, np.ones(2000))] for m in (held, ~held)])


def test_blocks_hold_all_rows_and_few_records(spark, monkeypatch):
    """Passes read a record a block, however many rows; blocks of any size give the same models."""
    df = _step_frame(spark, 3000)
    kw = dict(constraints=[1, 0], params=GrowParams(max_depth=3, subsample=0.7), nfold=3, num_boost_round=4,
              early_stopping_rounds=None, key_cols=["id"], max_bin=16)
    frame, cuts, n, scales = training_frame(df, ["y"], ["x", "z"], None, ["id"], 3, 42, 16, partitions=3)
    g = Grower(frame, 2, n_bins(cuts), 1, [0, 0], make_specs(1, [0.5], [GrowParams(subsample=0.7)], 3, 2), scales)
    blocks = g._pack(frame).select("_size").collect()
    assert len(blocks) == 3 and sum(np.frombuffer(b[0], np.int32).sum() for b in blocks) == n == 3000
    frame.unpersist()
    want = fit_models(df, ["y"], ["x", "z"], [0.2, 0.7], **kw)
    monkeypatch.setattr(GR, "BLOCK_ROWS", 64)
    monkeypatch.setattr(GR, "MIN_CELL_ROWS", 1 << 30)  # no sums kept: every pass reads the rows
    got = fit_models(df, ["y"], ["x", "z"], [0.2, 0.7], **kw)
    for a, b in zip(want.model_set.models, got.model_set.models):
        assert [t.split_bin for t in a.trees] == [t.split_bin for t in b.trees]
        assert all(np.allclose(x.value, y.value) for x, y in zip(a.trees, b.trees))


def test_many_leaves_share_the_buckets_of_a_pass(spark):
    grower, _ = _leaf_grower(spark, [(1, 1.0, 1.0)], [0.5], 1.0, 4096)
    assert grower._parts(96) == 4096
    assert max(grower._parts(n) * n for n in (1, 1000, 12_288)) <= GR.LEAF_CELLS


def test_copies_are_written_out_by_several_tasks(spark):
    """Few contents with many copies each are small before they are written out, and not all one task's work."""
    rows = spark.range(200_000).select((F.col("id") % 20).alias("x"))
    sizes = [r["count"] for r in with_row_keys(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 1 and max(sizes) < 150_000


def test_few_values_need_no_sketch_and_sketches_are_one_a_core(spark, monkeypatch):
    sketched, merged = [], []
    sketch, coalesce = BN.F.percentile_approx, DataFrame.coalesce
    monkeypatch.setattr(BN.F, "percentile_approx", lambda c, *a: sketched.append(c) or sketch(c, *a))
    monkeypatch.setattr(DataFrame, "coalesce", lambda df, n: merged.append(n) or coalesce(df, n))
    df = spark.range(6000, numPartitions=40).selectExpr("cast(id % 9 as double) as x", "cast(id as double) as z")
    cuts, row = BN.compute_cuts(df, ["x", "z"], 16, extra_aggs=[F.count(F.lit(1)).alias("n")])
    assert row["n"] == 6000 and list(cuts[0]) == [float(i) for i in range(1, 9)]
    assert len(cuts[1]) == 15 and np.allclose(cuts[1], np.arange(1, 16) * 375, atol=10)
    assert len(sketched) == 1 and merged == [spark.sparkContext.defaultParallelism]


def test_values_are_binned_as_they_are_packed(spark):
    """No pass of its own bins the rows; blocks of values equal those of rows that are binned before."""
    assert BN.bin_matrix([np.array([np.nan, -np.inf, -0.0, 0.0, 1.0, 2.5, np.inf]), np.zeros(7)],
                         [np.array([0.0, 2.0]), np.zeros(0)], np.uint8).T.tolist() == [[0, 1, 2, 2, 2, 3, 3], [1] * 7]
    df = _step_frame(spark, 500).selectExpr("id", "y", "if(id % 11 = 0, null, x) as x", "if(id % 7 = 0, double('nan'), z) as z")
    args = (df, ["y"], ["x", "z"], None, ["id"], 3, 42, 8, 3)
    binned, cuts, _, scales = training_frame(*args)
    values, _, _, _, source = training_frame(*args, keep_source=True)
    assert "_bins" not in values.columns and {"_x0", "_x1"} <= set(values.columns)
    grower = Grower(values, 2, n_bins(cuts), 1, [], make_specs(1, [0.5], [GrowParams()], 3, 1), scales, cuts=cuts)
    names = ["_bins", "_fold", "_size", "_segs"]
    rows = [sorted(tuple(bytes(r[c]) for c in names) for r in grower._pack(f).select(*names).collect()) for f in (binned, values)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    binned.unpersist()
    source.unpersist()


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
@pytest.mark.parametrize("parts", [3, 64, 4096])
def test_residual_buckets_never_decrease(scale, parts):
    r = np.random.default_rng(2).normal(0, 1, 40_000)
    r = np.sort(np.r_[r, r * 1e-9, r * 1e9, 0.0, -0.0, 1e300, -1e300])
    got = TR.residual_bucket(r, scale, parts)
    assert (np.diff(got) >= 0).all() and got[0] >= 0 and got[-1] == parts - 1


@pytest.mark.parametrize("miss", [False, True])
def test_leaf_values_found_by_a_sample_are_exact(spark, monkeypatch, miss):
    """Ranges from one row in 64: the quantile of all rows, also of leaves too small for it and where the range is wrong."""
    rng = np.random.default_rng(3)
    y = np.round(np.r_[rng.normal(1000.0, 250.0, 30_000), rng.normal(-5, 1e-6, 40)], 9)
    w, b = np.round(rng.uniform(0.0, 2.0, len(y)), 3), np.r_[rng.integers(1, 3, 30_000), np.full(40, 3)]
    rows = [(int(k), float(v), float(x)) for k, v, x in zip(b, y, w)]
    grower, frame = _leaf_grower(spark, rows, [0.0, 0.3, 0.9, 1.0], 1e-6, 4096)
    grower.rows_per_task = GR.SAMPLE_ROWS
    if miss:
        monkeypatch.setattr(GR, "_likely_ranges", lambda found, q: (np.full(len(q), 1e6), np.full(len(q), 2e6)))
    sampled, leaf_pass = [], grower._leaf_pass
    monkeypatch.setattr(grower, "_leaf_pass", lambda *a, sample=False, **k: sampled.append(sample) or leaf_pass(*a, sample=sample, **k))
    trees = {}
    for st in grower.models:
        t = trees[st.spec.model_id] = Tree()
        t.add_children(0, 0, 1, True, 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
        t.add_children(2, 0, 2, True, 1.0, (-np.inf, np.inf), (-np.inf, np.inf), 1.0, 1.0)
    got = grower._leaf_values(grower._pack(frame), grower.models, trees, rnd=-1, with_pred=False)
    assert sampled[0] and not any(sampled[1:])
    for st in grower.models:
        want = {node: _weighted_quantile(y[b == k], w[b == k], st.spec.quantile) for node, k in ((1, 1), (3, 2), (4, 3))}
        assert got[st.spec.model_id] == want


def test_rows_of_a_cell_share_a_partition_unless_they_are_many(spark):
    rows = spark.range(40_000).selectExpr("id as _rk", "cast(if(id % 2 = 0, 0, id % 400) as double) as _x0")
    at = _by_cells(rows, ["_x0"], 40_000, 8).groupBy("_x0", F.spark_partition_id().alias("p")).count().toPandas()
    sizes = at.groupby("p")["count"].sum()
    assert sizes.sum() == 40_000 and len(sizes) == 8 and sizes.max() < 8_000
    small = at[at["_x0"] > 0].groupby("_x0")["p"].nunique()
    assert len(small) == 200 and (small > 1).sum() <= 7
