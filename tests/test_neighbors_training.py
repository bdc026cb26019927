"""Neighbour search against brute force, over-sampling sizes, nested claims, training helpers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import neighbors as NB
from claimlens.plans import features as FE
from claimlens.plans import scoring as SC
from claimlens.plans import training as TR


def _brute(X, ids, k):
    out = set()
    for i, q in enumerate(X):
        d = np.sqrt(((X - q) ** 2).sum(axis=1))
        order = sorted((d[j], ids[j]) for j in range(len(X)) if j != i)
        for r, (dist, nid) in enumerate(order[:k], start=1):
            out.add((ids[i], nid, r))
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_knn_exact(spark, k):
    rng = np.random.default_rng(3)
    # clustered points so pivots can prune, plus duplicates to exercise ties
    X = np.concatenate([rng.normal(c, 0.3, size=(60, 4)) for c in (0, 5, 10)] + [np.zeros((3, 4))])
    ids = list(range(100, 100 + len(X)))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X)], "id long, vec array<double>")
    got = {(r.id, r.nb_id, r.rank) for r in NB.knn(df, k).collect()}
    assert got == _brute(X, ids, k)


def test_oversample_sizes(spark):
    rows = [(i, 1 if i < 12 else 0, [float(i % 5), float(i % 7)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    with pytest.raises(ValueError):
        NB.oversample(df, k=858, ratio=0.2)
    out = NB.oversample(df, k=11, ratio=0.2).toPandas()
    n_new = int(188 * 0.2 - 12)
    assert out.is_synthetic.sum() == n_new
    assert (out[out.is_synthetic].label == 1).all() and len(out) == 200 + n_new
    # synthetic points lie on segments between minority points: inside their bounding box
    mins = np.array([v for v in out[~out.is_synthetic & (out.label == 1)].vec])
    syn = np.array([v for v in out[out.is_synthetic].vec])
    assert (syn >= mins.min(axis=0) - 1e-9).all() and (syn <= mins.max(axis=0) + 1e-9).all()


def test_curve_rounds():
    rounds = TR.curve_rounds
    assert rounds(612)[:3] == [1, 13, 25] and rounds(612)[-1] == 612
    assert rounds(3) == [1, 2, 3]


def test_neighbours_of_text_ids(spark):
    df = spark.createDataFrame([(f"c{i}", 1 if i < 4 else 0, [float(i), 0.0]) for i in range(20)], "id string, label int, vec array<double>")
    nearest = {(r.id, r.nb_id) for r in NB.knn(df, 1).collect()}
    assert ("c0", "c1") in nearest and len(nearest) == 20
    out = NB.oversample(df, k=2, ratio=0.5).where("is_synthetic").collect()
    assert sorted(r.id for r in out) == [f"synthetic-{k}" for k in range(1, 5)]
    with pytest.raises(ValueError):
        NB.oversample(df.where("label = 0"), k=2)


def test_nested_claim_scoring(spark):
    claim = (101, "p1", "1", "P", "1", "E11.9", 12_000_000.0, "291", "B", 55,
             dt.datetime(2022, 6, 10), dt.datetime(2022, 6, 24), "1", "E-4-10-I", 2, "-", "-", "-", "-", "-", 0,
             [("E11.9", 1), ("I10", 2), ("I10", 2), ("K29", 2), ("J18", 2), ("N18", 2)], ["99.04"] * 7)
    schema = ("id long, id_peserta string, jenispulang string, jenkel string, pisat string, diagfktp string, "
              "biaya double, dati2 string, typefaskes string, usia int, tgldatang timestamp_ntz, "
              "tglpulang timestamp_ntz, jenispel string, cbg string, kelasrawat int, kdsa string, kdsp string, "
              "kdsr string, kdsi string, kdsd string, label int, "
              "diagnoses array<struct<diag:string, levelid:int>>, procedures array<string>")
    nested = spark.createDataFrame([claim], schema)
    c, d, p = SC.flatten_nested(nested)
    params = FE.fit(c, d, p)
    counts = SC.nested_counts(nested).first()
    assert (counts.n_secondary, counts.n_procedures, counts.primary_diag) == (5, 7, "E11.9")
    f = FE.transform(c, d, p, params).first()
    assert f.diagfkrtl_sekunder_counts == 4 and f.proc_count == 1   # features count de-duplicated rows
    out = SC.score_nested(nested, params, threshold=0.0).first()
    assert out.is_fraud == 1 and 0.5 <= out.confidence_score <= 1.0
    assert "cost" in out.explanation and "14 days" in out.explanation and "secondary diagnoses 5" in out.explanation
    assert out.model_info.threshold == 0.0


def test_sparse_oversampling_equals_dense(spark):
    """Neighbours, synthetic rows and the stored vectors of sparse rows equal those of the dense rows, bit by bit."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from claimlens.operators import sparse as SP
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        x = np.where(rng.random(40) < 0.15, rng.normal(0, 10 ** rng.integers(0, 7), 40), 0.0)
        if i % 10 == 0:
            x = np.zeros(40)  # equal rows without any occupied slot
        v = Vectors.dense(x) if i % 2 else Vectors.sparse(40, [(int(k), float(x[k])) for k in np.flatnonzero(x)])
        rows.append((i, 1 if i < 60 else 0, v))
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    dense = df.select("id", "label", vector_to_array("features").alias("vec"))
    thin = df.select("id", "label", SP.sparse("features").alias("vec"))
    assert {tuple(r) for r in NB.knn(dense, 7).collect()} == {tuple(r) for r in NB.knn(thin, 7).collect()}
    want = {r.id: (r.label, r.is_synthetic, r.vec) for r in NB.oversample(dense, 7, ratio=0.9).collect()}
    out = SP.stored_vectors(NB.oversample(thin, 7, ratio=0.9), "vec")
    got = {r.id: (r.label, r.is_synthetic, r.vec) for r in out.collect()}
    assert len(got) == 150 + 21 and got.keys() == want.keys()
    for i, (label, synthetic, v) in got.items():
        assert (label, synthetic) == want[i][:2] and v.toArray().tolist() == want[i][2]


def test_rebalancing_ships_no_dense_array(spark, tmp_path):
    """What crosses the shuffles of over-sampling is slots and values only."""
    from pyspark.ml.linalg import Vectors

    from claimlens.operators import sparse as SP
    df = spark.createDataFrame([(i, int(i < 9), Vectors.sparse(100_000, [(i, 1.0), (99_999, float(i))])) for i in range(60)], ["id", "label", "features"])
    out = NB.oversample(df.select("id", "label", SP.sparse("features").alias("vec")), 3, ratio=0.5)
    assert out.select(F.max(F.size("vec.values"))).first()[0] <= 3
    assert "vector_to_array" not in out._jdf.queryExecution().toString()
    assert out.where("is_synthetic and vec.size = 100000").count() == 16


def test_lsh_neighbours(spark):
    """Recall on points without clusters, a crowd of copies split into parts, right distances, no rows."""
    from claimlens.operators import lsh as LSH
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(size=(1200, 24)), np.full((300, 24), 2.0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)] + [(9_999, None)], "id long, vec array<double>")
    loose = df.where("id < 1200")
    r = LSH.recall(LSH.lsh_knn(loose, 5, tables=24, target=128), NB.knn(loose, 5)).first()
    assert r.n_links == 6000 and r.recall >= 0.9
    got = LSH.lsh_knn(df, 5, tables=4, target=64).collect()
    for row in got:
        assert row.id != row.nb_id and abs(row.dist - np.sqrt(((X[row.id] - X[row.nb_id]) ** 2).sum())) < 1e-9
    assert sum(row.dist == 0 and row.id >= 1200 for row in got) == 300 * 5
    named = LSH.bucket_names(df.where("vec is not null").selectExpr("id", "vec").withColumn("features", LSH.array_to_vector("vec")), 4, 12, 2.0, 1)
    held = LSH.buckets(named, 64).groupBy("bucket", "part").count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] <= 130 and held[1] == 1500 * 4  # parts by hash are not quite even
    assert LSH.lsh_knn(df.where("id < 0"), 5).collect() == []


def test_pairs_are_narrowed_by_products_and_measured_anew():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 16)) + 1e6, np.full((3, 16), 1e6)])  # far from 0, with copies
    same = np.eye(len(x), dtype=bool)
    qi, mi, limit = NB._possible(x, x, same, 4, np.full(len(x), np.inf))
    assert len(qi) < 10 * len(x) and not (qi == mi).any()
    found = NB._distances(x, x, qi, mi)
    for i in (0, 7, 299, 301):
        d = np.sqrt(((x - x[i]) ** 2).cumsum(axis=1)[:, -1])
        d[i] = np.inf
        assert np.sort(found[qi == i])[:4].tolist() == np.sort(d)[:4].tolist()


def test_knn_exact_in_small_pieces(spark, monkeypatch):
    """Candidate rows leave a task in pieces, and members and queries meet in blocks."""
    monkeypatch.setattr(NB, "EMIT_DOUBLES", 64)
    monkeypatch.setattr(NB, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(0, 1, (90, 6)), np.zeros((5, 6))])
    ids = list(range(len(X)))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X)], "id long, vec array<double>")
    assert {(r.id, r.nb_id, r.rank) for r in NB.knn(df, 6).collect()} == _brute(X, ids, 6)
