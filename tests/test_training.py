"""Training on planted labels: the loop, its stop, the saved artefact, and curves over rounds."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimlens import queries as Q
from claimlens.plans import artefact as AR
from claimlens.plans import boosting as BO
from claimlens.plans import features as FE
from claimlens.plans import histograms as HI
from claimlens.plans import scoring as SC
from claimlens.plans import training as TR
from claimlens.plans import trees as TE
from claimlens.sources import fixtures as FX
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    f, params = FE.build(c, d, p)
    f = Q.planted(f).cache()
    cfg = TR.TrainConfig(max_iter=12, max_depth=4, oversample_k=3, step_size=0.3, early_stop_rounds=4)
    return f, params, cfg, TR.train(f, params.facility_vocab, cfg)


def test_training_outputs(spark, trained):
    f, params, cfg, r = trained
    assert r.model.getNumTrees == r.best_iteration
    assert len(r.val_loss) == len(r.train_loss) == r.fitted <= min(cfg.max_iter, r.best_iteration + cfg.early_stop_rounds)
    assert r.best_iteration == int(np.argmin(r.val_loss)) + 1
    with pytest.raises(ValueError):
        TR.train(f, params.facility_vocab, TR.TrainConfig(max_depth=64))
    assert r.num_features == 736 + len(params.facility_vocab) + 15
    ev = TR.evaluation(r.eval_scores).toPandas()
    assert set(ev.block) == {"val_metrics_default_0.5", "val_metrics_target_threshold",
                             "test_metrics_target_threshold"}
    for _, row in ev.iterrows():
        n = row.tn + row.fp + row.fn + row.tp
        assert n == r.eval_scores.where(F.col("split") == row.split).count()
        assert row.roc_auc > 0.8  # the label can be learnt


def test_running_scores_and_figures(spark, trained):
    f, params, cfg, r = trained
    enc = TR.prepare(f, params.facility_vocab, cfg)[1]
    full = {x.id: x.probability for x in r.model.transform(enc.select("id", "features")).collect()}
    last = {x.id: x.score for x in TR.partial_scores(r.model, enc.select("id", "features"), [r.best_iteration]).collect()}
    assert full.keys() == last.keys() and all(abs(full[k] - last[k]) < 1e-12 for k in full)
    val = enc.where("split = 'val'").select(F.lit("val").alias("set"), "label", "features")
    rounds = list(range(1, r.best_iteration + 1))
    got = {x.iteration: x for x in TR.round_figures(TR.running_scores(r.model, val, rounds), rounds, 0.5).collect()}
    assert all(abs(got[k].loss - r.val_loss[k - 1]) < 1e-9 for k in rounds)  # what training measured after each round
    rows = TR.partial_scores(r.model, val, [1]).collect()
    tp, fp, fn = (sum(c(x) for x in rows) for c in (lambda x: x.score >= 0.5 and x.label == 1, lambda x: x.score >= 0.5 and x.label == 0,
                                                     lambda x: x.score < 0.5 and x.label == 1))
    assert abs(got[1].precision - tp / (tp + fp + 1e-10)) < 1e-12 and abs(got[1].recall - tp / (tp + fn + 1e-10)) < 1e-12


def test_run_record_nested(spark, trained):
    f, params, cfg, r = trained
    rec = TR.run_record(spark, r, TR.evaluation(r.eval_scores), cfg).first()
    assert rec.best_iteration == r.best_iteration
    assert rec.test_metrics_target_threshold.confusion_matrix.tp >= 0


def test_one_artefact_scores_tables_and_lists(spark, trained, tmp_path):
    f, params, cfg, r = trained
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    artefact = AR.assembled(params, r.encoder, r.model)
    artefact.write().overwrite().save(str(tmp_path / "a"))
    loaded = PipelineModel.load(str(tmp_path / "a"))
    lists = (c.join(d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "diag", "levelid"))).alias("l")), "id", "left")
             .withColumn("diagnoses", F.transform("l", lambda x: F.struct(x["diag"].alias("diag"), x["levelid"].alias("levelid")))).drop("l")
             .join(p.groupBy("id").agg(F.collect_list("proc").alias("procedures")), "id", "left"))
    # tables keep a null code apart from an empty one; lists do not
    plain = d.withColumn("diag", F.coalesce("diag", F.lit("")))
    want = {x.id: x for x in AR.score_tables(artefact, c, plain, p).collect()}
    got = {x.id: x for x in AR.score_lists(loaded, lists).collect()}
    assert want.keys() == got.keys() and len(got) == c.count()
    assert all(abs(want[k].fraud_probability - got[k].fraud_probability) < 1e-12 and want[k].is_fraud == got[k].is_fraud for k in want)
    assert all(x.model_info.threshold == 0.7868109 and x.explanation for x in got.values())


def test_nested_scoring_is_one_projection(spark, trained, tmp_path):
    f, params, cfg, r = trained
    nested = Q.nested_table(spark, SF_SMALL)
    nested.write.parquet(str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n"))
    for df in (SC.score_nested(back, params), AR.score_lists(AR.assembled(params, r.encoder, r.model), back)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Join", "Generate", "Aggregate"))


def test_pipeline_fits_everything(spark, trained):
    f, params, cfg, r = trained
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    rows = FE.with_child_tables(c.drop("label"), FE.diag_parts(d), FE.proc_table(p)).join(f.select("id", "label"), "id")
    small = TR.TrainConfig(max_iter=2, max_depth=2, oversample_k=3)
    fitted = AR.pipeline(small).fit(rows)
    assert fitted.stages[0].params_of() == FE.fit(c, d, p)
    assert json.loads(AR.FraudTrees(config=json.dumps(vars(small))).getOrDefault("config"))["max_iter"] == 2
    out = AR.for_scoring(fitted).transform(rows)
    assert out.columns[:4] == ["id", "fraud_probability", "is_fraud", "confidence_score"] and out.count() == c.count()


def test_transform_before_fit_raises(spark):
    with pytest.raises(ValueError, match="not fitted"):
        AR.ClaimFeaturesModel().transform(spark.range(1))
    with pytest.raises(ValueError, match="no trees"):
        TE.BoostedTreesModel().transform(spark.range(1))


def xor_rows(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (n, 5))
    y = (x[:, 0] * x[:, 3] > 0).astype(int)
    part = ["fit" if k % 4 < 2 else "val" if k % 4 == 2 else "train" for k in range(n)]
    return x, y, part, spark.createDataFrame([(part[k], int(y[k]), 1.0, Vectors.dense(x[k])) for k in range(n)], ["part", "label", "w", "features"])


def test_boosting_learns_and_stops(spark):
    x, y, part, rows = xor_rows(spark)
    cfg = BO.BoostConfig(max_iter=15, max_depth=3, step_size=0.5, column_share=1.0, patience=3, alpha=0.0, reg_lambda=1.0)
    r = BO.fit(rows, 5, cfg)
    assert r.fitted <= r.best_iteration + 3 and r.losses["val"][r.best_iteration - 1] == min(r.losses["val"])
    val = [k for k in range(len(y)) if part[k] == "val"]
    p = 1 / (1 + np.exp(-r.model.trees.outputs(x[:, r.model.trees.slots()]).sum(1)))
    assert ((p[val] > 0.5) == y[val]).mean() > 0.85
    loss = -np.mean(np.where(y[val] == 1, np.log(p[val]), np.log(1 - p[val])))
    assert abs(loss - r.losses["val"][r.best_iteration - 1]) < 1e-9  # margins kept by Spark equal the walk of the arrays
    # patience counts from the least loss
    assert BO.stop_at([5, 4, 3, 3.5, 3.6], 2) == (3, True) and BO.stop_at([5, 4, 3, 3.5], 2) == (3, False)
    noise = rows.withColumn("label", F.when(F.col("part") == "val", 1 - F.col("label")).otherwise(F.col("label")))
    stopped = BO.fit(noise, 5, cfg)  # validation gets worse from the first round on
    assert stopped.best_iteration == 1 and stopped.fitted == 4


def test_first_round_is_the_newton_step(spark):
    x, y, part, rows = xor_rows(spark)
    cfg = BO.BoostConfig(max_iter=1, max_depth=2, step_size=0.3, column_share=1.0, alpha=1.5, reg_lambda=2.0)
    t = BO.fit(rows, 5, cfg).model.trees
    grow = [k for k in range(len(y)) if part[k] == "fit"]
    out = t.outputs(x[:, t.slots()])[:, 0]
    for leaf in np.unique(out):
        mine = [k for k in grow if out[k] == leaf]
        g, h = sum(0.5 - y[k] for k in mine), 0.25 * len(mine)
        assert abs(leaf - BO.leaf_value(g, h, cfg)) < 1e-9
    assert BO.leaf_value(1.0, 4.0, cfg) == 0.0 and BO.leaf_value(-3.5, 3.0, cfg) == pytest.approx(0.3 * 2.0 / 5.0)


def test_trees_walk_and_save(spark, tmp_path):
    trees = TE.Trees.of([[(7, 0.5, 1, 2, None), (None,) * 4 + (-1.0,), (3, -2.0, 3, 4, None), (None,) * 4 + (2.0,), (None,) * 4 + (5.0,)], [(None,) * 4 + (0.25,)]])
    assert trees.slots().tolist() == [3, 7]
    assert trees.outputs(np.array([[0.0, 0.5], [-2.0, 0.6], [0.0, 9.0]])).tolist() == [[-1.0, 0.25], [2.0, 0.25], [5.0, 0.25]]
    TE.BoostedTreesModel(trees).write().overwrite().save(str(tmp_path / "m"))
    back = TE.BoostedTreesModel.load(str(tmp_path / "m"))
    rows = spark.createDataFrame([(k, Vectors.sparse(10, {3: a, 7: b})) for k, (a, b) in enumerate([(0.0, 0.5), (-2.0, 0.6), (0.0, 9.0)])], ["id", "features"])
    got = [r.probability for r in back.transform(rows).orderBy("id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([-0.75, 2.25, 5.25]))))
    assert [r.p for r in TE.BoostedTreesModel(TE.Trees.of([])).transform(rows).selectExpr("probability as p").collect()] == [0.5] * 3


def test_a_round_does_not_hold_the_plans_of_those_before(spark, monkeypatch):
    """The plan that a tree is fitted on has the same size in every round up to the next checkpoint."""
    sizes, fit = [], BO.DecisionTreeRegressor.fit

    def measured(self, rows):
        sizes.append(len(rows._jdf.queryExecution().executedPlan().toString()))
        return fit(self, rows)

    monkeypatch.setattr(BO.DecisionTreeRegressor, "fit", measured)
    rows = spark.createDataFrame([(part, int(i % 10 > 5), 1.0, Vectors.dense([i % 10, i % 3])) for i in range(60) for part in (BO.FIT, "val")],
                                 ["part", "label", "w", "features"])
    r = BO.fit(rows, 2, BO.BoostConfig(max_iter=6, max_depth=2, step_size=0.3, column_share=1.0, min_leaf_weight=0.0))
    assert r.fitted == 6 and max(sizes[1:]) < 2 * sizes[1]
    assert r.losses["val"] == sorted(r.losses["val"], reverse=True)


def test_slots_of_sparse_and_dense_vectors_are_picked_alike(spark):
    v = [Vectors.sparse(5, [1, 3], [2.0, -1.0]), Vectors.dense([0.0, 2.0, 0.0, -1.0, 7.0]), Vectors.sparse(5, [], [])]
    rows = spark.createDataFrame([(x,) for x in v], ["features"]).select(F.unwrap_udt("features").alias("v")).select("v.*").toPandas()
    assert TE.picked(rows, np.array([1, 4])).tolist() == [[2.0, 0.0], [2.0, 7.0], [0.0, 0.0]]
    assert TE.picked(rows, np.zeros(0, np.int64)).shape == (3, 0)


def test_registered_training_has_the_full_settings(spark, monkeypatch):
    """Nothing of the recipe is left out: 1,000 rounds, 30 levels, patience 100, the reference's rate and neighbours."""
    seen = []
    monkeypatch.setattr(Q.TR, "train", lambda rows, vocab, cfg=None: seen.append(cfg or TR.TrainConfig()))
    monkeypatch.setattr(Q, "_TRAINED", {})
    Q.trained(spark, SF_SMALL)
    c = seen[0]
    assert c == TR.TrainConfig() and (c.max_iter, c.max_depth, c.early_stop_rounds, c.oversample_k, c.step_size) == (1000, 30, 100, 858, 0.05377367769556463)


def test_tasks_that_meet_grow_the_trees_of_one_task(spark, monkeypatch):
    """Several tasks, sparse and dense vectors, and few cells at a time give the same trees and losses."""
    x, y, part, rows = xor_rows(spark)
    cfg = BO.BoostConfig(max_iter=7, max_depth=5, step_size=0.3, column_share=0.8, alpha=0.2, reg_lambda=0.5)
    one = BO.fit(rows, 5, cfg)
    monkeypatch.setattr(BO, "TASK_ROWS", 100)
    thin = spark.createDataFrame([(part[k], int(y[k]), 1.0, Vectors.sparse(5, range(5), x[k].tolist()) if k % 3 else Vectors.dense(x[k])) for k in range(len(y))],
                                 ["part", "label", "w", "features"]).repartition(5)
    many = BO.fit(thin, 5, cfg)
    assert many.fitted == one.fitted == 7
    for k in ("train", "val"):
        assert np.allclose(many.losses[k], one.losses[k], rtol=0, atol=1e-9)
    assert np.allclose(many.model.trees.outputs(x[:, many.model.trees.slots()]), one.model.trees.outputs(x[:, one.model.trees.slots()]), atol=1e-9)


def local_grower(x, y, cfg, kind=0):
    """A grower over dense (1) or sparse (0) rows in this process."""
    v = [(kind, None, None, r.tolist()) if kind else (0, len(r), np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x]
    struct = pa.array([dict(zip(("type", "size", "indices", "values"), r, strict=True)) for r in v],
                      pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    part, w = np.array(["fit"] * len(x), object), np.ones(len(x))
    seen = HI.Summary(x.shape[1])
    seen.add(part, w, struct, "fit")
    layout = HI.Layout.of(seen, cfg.max_bins)
    g = HI.held(iter([HI.block(0, layout, part, y, w, struct, x.shape[1])]), layout, "fit")[0]
    g.total = lambda m: np.array(m, float)
    return g


def test_splits_are_the_best_by_brute_force(monkeypatch):
    """One-hot groups share columns; the root's split has the greatest gain of all cuts between values, at any number of cells."""
    rng = np.random.default_rng(4)
    x = np.zeros((300, 40))
    x[np.arange(300), rng.integers(0, 20, 300)] = 1.0                      # one group
    x[np.arange(300), 20 + rng.integers(0, 15, 300)] = 1.0                 # another
    x[:, 35:] = rng.integers(-2, 4, (300, 5)) * np.array([1, 2, 1, 5, 0.5])  # few values, 0 among them
    y = ((x[:, 3] + x[:, 25] > 0) | (x[:, 36] > 2)).astype(int)
    cfg = BO.BoostConfig(max_depth=4, alpha=0.3, reg_lambda=0.0, step_size=1.0)
    g, grads, h = local_grower(x, y, cfg), 0.5 - y, np.full(300, 0.25)

    def score(a, b):
        return max(0.0, abs(a) - 0.3) ** 2 / b

    best = max(score(grads[m].sum(), h[m].sum()) + score(grads[~m].sum(), h[~m].sum()) for s in range(40) for v in np.unique(x[:, s])[:-1]
               for m in [x[:, s] <= v] if h[m].sum() >= 1 and h[~m].sum() >= 1)
    assert len(g.layout.cells) < 12
    tree = g.tree(range(40), cfg)
    m = x[:, tree[0][0]] <= tree[0][1]
    assert score(grads[m].sum(), h[m].sum()) + score(grads[~m].sum(), h[~m].sum()) == pytest.approx(best)
    walked = TE.Trees.of([tree])
    assert np.allclose(walked.outputs(x[:, walked.slots()])[:, 0], g.margin)  # rows moved by numbers go where their values go
    monkeypatch.setattr(HI, "CELLS", 64)
    again = local_grower(x, y, cfg, kind=1)
    again.tree(range(40), cfg)
    assert np.allclose(again.margin, g.margin)


def test_many_values_are_cut_at_weighted_quantiles(monkeypatch):
    monkeypatch.setattr(HI, "KEPT", 64)
    v = np.random.default_rng(2).normal(size=20_000)
    seen = HI.Summary(1)
    for part in np.array_split(v, 7):
        seen.take(HI.weighed(np.zeros(len(part), np.int64), part, np.ones(len(part))))
        seen.reduce()
    seen.weight = float(len(v))
    cuts = HI.Layout.of(seen, 7).cuts
    assert len(cuts) == 7 and np.allclose([(v <= c).mean() for c in cuts], np.arange(1, 8) / 8, atol=0.05)


def test_a_small_class_is_oversampled_from_its_other_rows(spark):
    rows = spark.createDataFrame([(i, int(i < 8), Vectors.dense([float(i), float(i % 3)])) for i in range(108)], ["id", "label", "features"])
    got = {r["label"]: r["count"] for r in TR.rebalanced(rows, TR.TrainConfig()).groupBy("label").count().collect()}
    assert got == {1: 19, 0: int(19 / TR.TrainConfig().undersample_ratio)}
