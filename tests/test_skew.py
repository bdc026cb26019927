"""Hot keys: one claim holds a third of all child rows; one neighbour cell is crowded."""

import numpy as np
import pandas as pd

from claimlens.operators import children as CH
from claimlens.operators import neighbors as NB
from tests.test_neighbors_training import _brute


def _pandas_prepared(pdf):
    d = pdf.sort_values("ord").drop_duplicates(subset=["id", "diag", "levelid"], keep="first")
    prim = d[d.levelid == 1].sort_values("ord").groupby("id").tail(1).set_index("id")["diag"]
    sec = d[d.levelid == 2].groupby("id").size()
    out = pd.DataFrame({"diag": prim})
    out["cnt"] = sec.reindex(out.index).fillna(0).astype(int)
    return {i: (r.diag, r.cnt) for i, r in out.iterrows()}


def test_hot_claim_child_tables(spark):
    rng = np.random.default_rng(5)
    n = 9000
    ids = np.where(np.arange(n) < n // 3, 1, rng.integers(2, 400, n))      # claim 1: a third of the rows
    diag = [f"{chr(65 + x % 26)}{x % 97:02d}" for x in rng.integers(0, 3000, n)]
    lvl = rng.integers(1, 3, n)
    ordv = rng.permutation(n)
    pdf = pd.DataFrame({"id": ids.astype("int64"), "diag": diag, "levelid": lvl.astype("int32"),
                        "ord": ordv.astype("int64")})
    df = spark.createDataFrame(pdf)
    got = {r.id: (r.diag, r.diagfkrtl_sekunder_counts) for r in CH.diag_prepared(df).collect()}
    assert got == _pandas_prepared(pdf)
    proc = spark.createDataFrame(pdf[["id", "diag"]].rename(columns={"diag": "proc"}))
    want = pdf[["id", "diag"]].drop_duplicates().groupby("id").size().to_dict()
    assert {r.id: r.proc_count for r in CH.proc_counts(proc).collect()} == want


def test_crowded_cell_split_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(NB, "BUCKET_TARGET", 25)       # force sub-buckets inside cells
    rng = np.random.default_rng(9)
    X = np.concatenate([rng.normal(0, 0.01, size=(150, 3)), rng.normal(5, 1.0, size=(30, 3))])
    ids = list(range(len(X)))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X)], "id long, vec array<double>")
    got = {(r.id, r.nb_id, r.rank) for r in NB.knn(df, 7).collect()}
    assert got == _brute(X, ids, 7)
