"""Tiled comparison and VA-file clustering against brute force, with odd rows."""

import hashlib

import numpy as np
import pytest

from claimlens.llm import tiles, vafile

SCHEMA = "vec_id long, embedding array<float>, cid int, n long, cluster string, leaf int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], schema).repartition(3)


def odd_rows(d):
    return [(5001, None), (5002, []), (5003, [0.0] * d), (5004, [1.0] * (d - 1) + [None]), (5005, [float("nan")] * d), (5006, [float("inf")] + [1.0] * (d - 1)),
            (None, None)]


def linked_rows(rows, least):
    """(vec_id, n_links, component_id, kept) of every row, by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if good[a] and good[b] and len(x) == len(y):
                x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    near[a].append(b)
                    near[b].append(a)
    out, seen = [], {}
    for a in range(len(rows)):
        if a not in seen:
            todo, part = [a], {a}
            while todo:
                for b in near[todo.pop()]:
                    if b not in part:
                        part.add(b)
                        todo.append(b)
            ids = [rows[b][0] for b in part if rows[b][0] is not None]
            seen |= dict.fromkeys(part, min(ids, default=None))
        out.append((rows[a][0], len(near[a]), seen[a], rows[a][0] == seen[a]))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def groups(d, seed, n=300):
    """Float rows: loose ones, groups of near copies, a chain, exact copies, multiples."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(d) for _ in range(n)]
    for k in range(6):
        x += [x[k] + rng.standard_normal(d) * rng.uniform(0.1, 0.5) for _ in range(12)]
    step = x[0]
    for _ in range(25):
        step = step + rng.standard_normal(d) * 0.25
        x.append(step)
    x += [x[7]] * 40 + [x[8] * 3, x[8] * 1e-3, -x[8]]
    return [[float(v) for v in np.float32(y)] for y in x]


@pytest.mark.parametrize("d", [3, 16, 40])
def test_links_by_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(tiles, "SMALLEST", 32)  # many leaves, blocks and tiles
    monkeypatch.setattr(tiles, "TILE", 16)
    rows = list(enumerate(groups(d, d))) + odd_rows(d)
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, [float(x) for x in np.float32(np.linspace(1, 9, d) * (-1) ** np.arange(d))]), (6000, [1.0] * (d + 2)), (6001, [2.0] * (d + 2))]
    assert found(tiles.near_duplicates(frame(spark, rows))) == linked_rows(rows, 0.9)


def test_exact_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, float(np.sqrt(1 - 0.81))]), (3, [0.0, -1.0]), (4, [3.0, 4.0]), (5, [5.0, 0.0]), (6, [1e300, 1e300]), (7, [1e-300, 1e-300])]
    schema = SCHEMA.replace("float", "double")
    assert found(tiles.near_duplicates(frame(spark, rows, schema))) == linked_rows(rows, 0.9)
    assert found(tiles.near_duplicates(frame(spark, rows, schema), least=0.6)) == linked_rows(rows, 0.6)  # 4 and 5: exactly 0.6


def test_hot_vector_and_empty_table(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(4000)] + [(5000 + k, [float(v) for v in rng.standard_normal(3)]) for k in range(50)]
    got = {r.vec_id: r for r in tiles.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == 4050 and got[3999].component_id == 0 and got[3999].n_links >= 3999 and not got[3999].kept and got[0].kept
    assert tiles.near_duplicates(frame(spark, rows).limit(0)).collect() == []
    assert found(tiles.near_duplicates(frame(spark, odd_rows(3)))) == linked_rows(odd_rows(3), 0.9)


def test_forest_and_boxes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, n))))
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert tiles.forest(u, v, n).tolist() == want
    x = rng.standard_normal((500, 5))
    tree = tiles.Tree(x, 16)
    at = tree.leaf_of(x)
    assert sorted(set(at)) == list(range(16)) and np.bincount(at).max() <= 40


def clusters(rows, k=16, rounds=3, d=64, scale=64):
    """The contract by plain integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in named[:k]] or [[0] * d]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(x) for _, x in kept]
    inertia = sum(s for s, _ in last)
    return sorted(((i, j, s, sum(t for t, c in last if c == j), inertia, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (s, j) in zip(kept, last, strict=True)), key=str)


def clustered(df, **kwargs):
    cols = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in cols) for r in vafile.clustered(df, **kwargs).collect()), key=str)


@pytest.mark.parametrize(("d", "bits", "k"), [(64, 6, 16), (8, 1, 5), (8, 3, 16), (5, 8, 4)])
def test_clusters_by_brute_force(spark, d, bits, k):
    rows = list(enumerate(groups(d, d, 150))) + odd_rows(d)
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[4][1]), (7000, [2.0] * (d + 1))] + [(8000 + j, rows[20][1]) for j in range(60)]
    assert clustered(frame(spark, rows), dims=d, bits=bits, k=k) == clusters(rows, k=k, d=d)


def test_few_no_and_too_large_vectors(spark):
    few = [(k, [float(k)] * 64) for k in range(3)]
    assert clustered(frame(spark, few)) == clusters(few)
    assert clustered(frame(spark, [(None, [1.0] * 64)])) == clusters([(None, [1.0] * 64)])
    assert clustered(frame(spark, few).limit(0)) == [] and clustered(frame(spark, odd_rows(64))) == clusters(odd_rows(64))
    with pytest.raises(Exception, match="or more"):
        clustered(frame(spark, [(1, [1e30] * 64)]))


def test_cells_bound_distances():
    rng = np.random.default_rng(2)
    x, cents = rng.integers(-900, 900, (400, 12)), rng.integers(-900, 900, (7, 12))
    for bits in (1, 4, 6, 8):
        cells = vafile.Cells(x.min(0), x.max(0), bits)
        raw = vafile.packed_bits(cells.of(x), bits)
        assert raw.shape[1] == -(-12 * bits // 8) and (vafile.unpacked_bits(raw, 12, bits) == cells.of(x)).all()
        low, high = vafile.intervals(cells.of(x), (x * x).sum(1), cells.tables(cents))
        exact = ((x[:, None] - cents[None]) ** 2).sum(2)
        assert (low <= exact).all() and (exact <= high).all()
        open_ = vafile.candidates(low, high)
        assert open_[np.arange(400), exact.argmin(1)].all()
        assert (vafile.measured(x, cents, open_)[0] == exact.argmin(1)).all()
    assert open_.sum(1).mean() < 2.5  # with eight bits few centroids stay open
