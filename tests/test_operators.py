"""Operator-level checks: child tables, prefix sums, medians, sampling, metrics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import children as CH
from claimlens.operators import metrics as ME
from claimlens.operators import sampling as SA
from claimlens.operators.prefix import exact_medians, hash_rank, md5_key, modes, stack


def test_primary_is_last_after_dedupe(spark):
    rows = [(1, "A", 1, 1), (1, "B", 1, 2), (1, "A", 1, 3), (2, "C", 2, 1), (2, "C", 2, 2), (2, "D", 2, 3)]
    d = spark.createDataFrame(rows, "id long, diag string, levelid int, ord long")
    dd = CH.dedupe_rows(d)
    assert {r.id: r.diag for r in CH.primary_diagnosis(dd).collect()} == {1: "B"}
    assert {r.id: r.diagfkrtl_sekunder_counts for r in CH.secondary_counts(dd).collect()} == {2: 2}
    prep = {r.id: r.diagfkrtl_sekunder_counts for r in CH.diag_prepared(d).collect()}
    assert prep == {1: 0}  # claim 2 has no primary, so it is absent


def test_proc_counts_dedupe(spark):
    p = spark.createDataFrame([(1, "99.04"), (1, "99.04"), (1, "88.78"), (2, None), (2, None)], "id long, proc string")
    assert {r.id: r.proc_count for r in CH.proc_counts(p).collect()} == {1: 2, 2: 1}


def test_exact_medians_match_numpy(spark):
    rng = random.Random(7)
    data = [("a", float(rng.randint(0, 50))) for _ in range(1001)] + \
           [("b", rng.random()) for _ in range(600)] + [("b", None), ("c", 5.0)]
    df = spark.createDataFrame(data, "name string, x double")
    got = {r.name: r.median for r in exact_medians(df).collect()}
    for k in ["a", "b", "c"]:
        xs = [x for n, x in data if n == k and x is not None]
        assert got[k] == pytest.approx(float(np.median(xs)), abs=1e-12)


def test_modes_tie_smallest(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "2"), ("a", "1"), ("a", None), ("b", "z")],
                               "name string, v string")
    assert {r.name: r.mode for r in modes(df).collect()} == {"a": "1", "b": "z"}


def test_hash_rank_matches_sort(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    r = hash_rank(df, md5_key("k", seed=42)).toPandas()
    import hashlib
    expected = sorted(range(3000), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
    got = list(r.sort_values("rank")["k"])
    assert got == expected
    assert list(r.sort_values("rank")["rank"]) == list(range(1, 3001))


@pytest.mark.parametrize("n,expected", [(25, 0), (75, 2), (125, 2), (1001, 20)])
def test_sample_size_half_even(n, expected):
    assert SA.sample_size(0.02, n) == expected


def test_sample_exact_size(spark):
    df = spark.range(0, 1001)
    assert SA.sample_exact(df, 0.02, 42).count() == 20


def test_split_disjoint_complete(spark):
    df = spark.range(0, 2000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    s = SA.stratified_split(df).toPandas()
    assert len(s) == 2000 and s["id"].is_unique
    for lab, g in s.groupby("label"):
        n = len(g)
        t = int(np.ceil(n * 0.2))
        v = int(np.ceil((n - t) * 0.25))
        assert (g.split == "test").sum() == t and (g.split == "val").sum() == v


@pytest.mark.parametrize("tn,fp,fn,tp,prec,rec,f1,spec", [
    (44846, 153, 358, 251, 0.6213, 0.4122, 0.4956, 0.9966),   # validation, threshold 0.5
    (44978, 21, 381, 228, 0.9157, 0.3744, 0.5315, 0.9995),    # validation, tuned threshold
    (44967, 32, 351, 258, 0.8897, 0.4236, 0.5740, 0.9993),    # test, tuned threshold
])
def test_published_metric_blocks(spark, tn, fp, fn, tp, prec, rec, f1, spec):
    rows = [(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp
    m = ME.metrics(spark.createDataFrame(rows, "label int, score double"), (0.7868109,)).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (tn, fp, fn, tp)
    assert [round(x, 4) for x in (m.precision, m.recall, m.f1_score, m.specificity)] == [prec, rec, f1, spec]


def test_metrics_identities(spark):
    # counts of the published test block: tn 44967, fp 32, fn 351, tp 258
    rows = [(0, 0.1)] * 44967 + [(0, 0.9)] * 32 + [(1, 0.1)] * 351 + [(1, 0.9)] * 258
    df = spark.createDataFrame(rows, "label int, score double")
    m = ME.metrics(df, (0.7868109,)).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (44967, 32, 351, 258)
    assert round(m.precision, 6) == 0.889655 and round(m.recall, 6) == 0.423645
    assert round(m.f1_score, 6) == 0.573971 and round(m.specificity, 6) == 0.999289


def test_pr_auc_anchor(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5)], "label int, score double")
    pts = ME.curve_points(df)
    assert round(ME.pr_auc(pts).first().pr_auc, 6) == 0.666667


def test_roc_auc_ties_and_degenerate(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.9), (0, 0.1)], "label int, score double")
    # pairs (pos, neg): (0.8,0.8)=0.5, (0.8,0.1)=1, (0.9,0.8)=1, (0.9,0.1)=1 -> 3.5/4
    assert ME.roc_auc(ME.curve_points(df)).first().roc_auc == pytest.approx(0.875)
    one = spark.createDataFrame([(0, 0.2), (0, 0.3)], "label int, score double")
    assert ME.roc_auc(ME.curve_points(one)).first().roc_auc == 0.5


def test_stack_long_form(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    got = sorted(stack(df, ["x", "y"], cast="string").collect(), key=lambda r: (r.name, str(r.v)))
    assert [(r.name, r.v) for r in got] == [("x", "1"), ("x", "2"), ("y", None), ("y", "a")]


def test_read_with_order(spark, tmp_path):
    from claimlens.sources.tables import read_with_order
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "A"), (1, "B"), (1, "A")], "id long, diag string").coalesce(1) \
        .write.parquet(path)
    d = read_with_order(spark, path).withColumn("levelid", F.lit(1))
    assert {r.id: r.diag for r in CH.primary_diagnosis(CH.dedupe_rows(d)).collect()} == {1: "B"}


def test_headline_defaults(spark):
    from claimlens.plans.training import headline
    recs = spark.createDataFrame([("2026-01-01 00:00:00", 0.5), ("2026-02-01 00:00:00", None)],
                                 "training_date string, classification_threshold double")
    h = headline(recs).first()
    assert h.training_date == "2026-02-01 00:00:00"
    assert (h.precision, h.recall, h.f1_score) == (0.9, 0.4, 0.55)
    assert h.classification_threshold == 0.7868109 and h.num_features == 342 and h.sample_fraction == 0.05


def test_approx_medians_close(spark):
    from claimlens.operators.prefix import approx_medians
    df = spark.range(0, 10001).select(F.lit("a").alias("name"), F.col("id").cast("double").alias("x"))
    m = approx_medians(df).first().median
    assert abs(m - 5000) <= 2


def test_sampled_tables_and_quality_report(spark):
    from claimlens.operators.quality import quality_report
    from claimlens.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    s, sd, sp = SA.sampled_tables(c, d, p, 0.1, 42)
    ids = {r.id for r in s.select("id").collect()}
    assert len(ids) == SA.sample_size(0.1, c.count())
    assert {r.id for r in sd.select("id").distinct().collect()} <= ids
    assert {r.id for r in sp.select("id").distinct().collect()} <= ids
    r = quality_report(c, "claims").first()
    assert r.num_rows == c.count() and r.num_cols == len(c.columns)
    assert r.missing_values["jenispulang"] > 0 and "id" not in r.missing_values
    assert r.dtypes["biaya"] == "double"


def test_roc_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(11)
    labels = (rng.random(3000) < 0.1).astype(int)
    scores = np.round(rng.random(3000) * 0.5 + labels * 0.2, 3)   # rounded: many ties
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(labels, scores)], "label int, score double")
    ours = ME.roc_auc(ME.curve_points(df)).first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    theirs = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_tune_threshold_brute_force(spark):
    rng = np.random.default_rng(21)
    labels = (rng.random(800) < 0.3).astype(int)
    scores = np.round(rng.random(800) * 0.6 + labels * 0.3, 2)
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(labels, scores)], "label int, score double")
    pts = ME.curve_points(df).withColumn("target_precision", F.explode(F.array(F.lit(0.5), F.lit(0.8))))
    got = {r.target_precision: (r.threshold, r.recall) for r in ME.tune_threshold_for_targets(pts).collect()}
    P = labels.sum()
    for target in (0.5, 0.8):
        best = None
        for t in sorted(set(scores)):
            pred = scores >= t
            tp, fp = int((pred & (labels == 1)).sum()), int((pred & (labels == 0)).sum())
            if tp + fp and tp / (tp + fp) >= target:
                cand = (tp / P, t)
                best = cand if best is None or cand > best else best
        assert got[target][0] == pytest.approx(best[1]) and got[target][1] == pytest.approx(best[0])


def test_samples_do_not_depend_on_partitioning(spark):
    """Repeated ids, null ids and null labels: the same rows whatever the partitioning, and none lost."""
    rows = [(i % 300 if i % 11 else None, i % 3 if i % 7 else None, i) for i in range(2000)]
    rows = [(i, None if y == 2 else y, x) for i, y, x in rows]
    seen = []
    for n in (1, 4, 13):
        df = spark.createDataFrame(rows, "id long, label int, x int").repartition(n, "x")
        split = SA.stratified_split(df)
        assert split.count() == 2000
        kept = SA.undersample(df.where("label is not null"))
        seen.append((sorted(map(tuple, split.collect()), key=str), sorted(map(tuple, SA.sample_exact(df, 0.1).collect()), key=str),
                     sorted(map(tuple, kept.collect()), key=str)))
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][1]) == 200
    for label in (0, 1, None):
        own = [r for r in seen[0][0] if r[1] == label]
        assert sum(r[3] == "test" for r in own) == -(-len(own) // 5)


def test_unknown_age_keeps_its_median(spark):
    from claimlens.operators import overview as OV
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (35, 5.0), (None, 8.0)], "usia int, biaya double")
    got = {r.age_band: (r.claims, r.median_cost) for r in OV.cost_by_age(df).collect()}
    assert got == {None: (3, 3.0), 30: (1, 5.0)}


def test_release_leaves_nothing_persisted(spark, tmp_path):
    """And what was fitted goes when the folder's files change."""
    import shutil

    from claimlens import queries as Q
    from tests.conftest import SF_SMALL
    sf = str(tmp_path)
    for t in ("orders", "customer", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{sf}/{t}.parquet")
    Q.release(spark)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for name in ("roc_auc", "overview_cost", "split"):
        Q.QUERIES[name](spark, sf).collect()
    n = Q.QUERIES["features"](spark, sf).count()
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(500).write.mode("overwrite").parquet(f"{sf}/new")
    shutil.copyfile(next(f for f in (tmp_path / "new").iterdir() if f.suffix == ".parquet"), f"{sf}/orders.parquet")
    assert Q.QUERIES["features"](spark, sf).count() == 500 != n
    Q.release(spark)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
