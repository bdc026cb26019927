"""Approximate nearest neighbours by inner product over balanced posting lists.

1. Equal vectors form a class, searched once; of a class's ids only the ``k + 1`` smallest can ever rank, since equal scores go to smaller ids.
2. Largest inner product becomes least distance: vectors are scaled by the largest norm and get one more component that
   brings all to norm 1; queries get 0 there.
3. Lists follow the table: one for ``LIST_SIZE`` classes, up to ``MOST_LISTS``. Their centroids come from a hash-ordered sample of ``PER_LIST``
   classes a list (``LEAST_SAMPLE`` at least): k-means over the sample, again inside each of its clusters, and clusters that hold more than 1.5
   times their share are split until lists are balanced. A graph links every centroid with its nearest; searches walk it in memory.
4. Every class goes to its nearest list and to those at most ``CLOSURE`` farther (``COPIES`` at most): boundary vectors stand in several.
5. A query reads all lists whose centroids are at most ``1 + ratio`` times as far as its nearest, however many, and more while they hold
   fewer than ``COPIES * (k + 1)`` entries. The ratio is measured: ``TRIALS`` classes, first in hash order, are compared with the whole table, and the
   ratio is the least one that reads lists holding the share ``AIM`` of their neighbours. So tables that cluster read few lists, others many.
6. Neighbouring lists make a cell (as many cells as the square root of the lists). Queries whose nearest lists lie in the same cell stand in the
   same block of about ``QUERY_BLOCK``; a class goes once to each block that reads one of its cells, there to one of ``STRIPES`` stripes. A task meets the
   queries of a block and then the classes of a stripe in batches, which it scores in double precision, a query against the classes of its own lists,
   and keeps the best k + 1 so far of each query. So ``STRIPES * (k + 1)`` rows a query leave the tasks, however large the table.

Sample, centroids, graph and trials are bounded; beyond ``MOST_LISTS`` lists grow, and then only their batches multiply.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null
id, nor vectors of another length than the most frequent one. Rows repeated with id and vector count once; a query's own id is never among its
neighbours. Ties go to the smaller id. Fewer candidates than k give as many rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches, stored

LIST_SIZE, MOST_LISTS = 200, 16_384
PER_LIST, LEAST_SAMPLE = 16, 16_384
COPIES, CLOSURE = 4, 0.1
TRIALS, AIM = 128, 0.97
LINKS, WIDTH, ENTRIES = 16, 48, 128
CELLS = 4 << 20  # rows times centroids that one step of a search marks
QUERY_BLOCK, STRIPES = 2048, 8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, each once."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(sound & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (top["d"] if top else 0))


def classes_of(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cid, embedding, first_id) of distinct vectors, and (cid, vec_id) with the k + 1 smallest ids of each."""
    first = rows.groupBy("embedding").agg(F.min("vec_id").alias("first_id"))
    classes = stored(first.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    smallest = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    return classes, stored(smallest.join(classes, "embedding").select("cid", "vec_id"), "vector-members")


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)


def _means(x: np.ndarray, c: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's steps; an empty cluster keeps its centre."""
    for _ in range(steps):
        at = _distances(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, _distances(x, c).argmin(1)


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; clusters above 1.5 times the mean size are split in two while there are fewer than 2 k."""
    if len(x) <= 1 or k <= 1:
        return x[:1]
    rng = np.random.default_rng(7)
    c, at = _means(x, x[rng.choice(len(x), min(k, len(x)), replace=False)], 8)
    while len(c) < 2 * k:
        sizes = np.bincount(at, minlength=len(c))
        big = int(sizes.argmax())
        rows = np.flatnonzero(at == big)
        if sizes[big] <= max(2, 1.5 * len(x) / len(c)):
            break
        two, side = _means(x[rows], x[rows][rng.choice(len(rows), 2, replace=False)], 6)
        if side.min() == side.max():
            break
        c = np.vstack([c, two[1:]])
        c[big] = two[0]
        at[rows[side == 1]] = len(c) - 1
    return c


def list_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """About ``lists`` centroids of the sample: in one step while they are few, else cluster by cluster."""
    if lists <= 256 or len(x) <= lists:
        return balanced_centroids(x, lists)
    top = balanced_centroids(x, int(np.sqrt(lists)))
    at = np.concatenate([_distances(x[i:i + 4096], top).argmin(1) for i in range(0, len(x), 4096)])
    parts = [x[at == j] for j in range(len(top))]
    return np.vstack([balanced_centroids(p, max(1, round(lists * len(p) / len(x)))) for p in parts if len(p)])


def cells_of(centroids: np.ndarray) -> np.ndarray:
    """The cell of each list: clusters of the centroids, as many as the square root of their number."""
    count = max(1, int(np.sqrt(len(centroids))))
    start = centroids[np.random.default_rng(7).choice(len(centroids), count, replace=False)]
    return _means(centroids, start, 8)[1]


def query_blocks(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell that holds so many queries: cells of few share a block, those above ``size`` have several."""
    first, parts, block, room = np.zeros(len(held), int), np.maximum(1, -(-held // size)), -1, 0
    for cell, n in enumerate(held):
        if n > room or block < 0:
            block, room = block + 1, size
        first[cell] = block
        block += parts[cell] - 1
        room = room - n if parts[cell] == 1 else 0
    return first, parts


class Graph:
    """Centroids linked with their nearest; finds near centroids of many vectors at a time."""

    def __init__(self, centroids: np.ndarray, links: int = LINKS):
        self.c, self.squares = centroids, (centroids**2).sum(1)
        n = len(centroids)
        near = np.vstack([np.argsort(_distances(centroids[i:i + 512], centroids), axis=1, kind="stable")[:, 1:links + 1] for i in range(0, n, 512)])
        ring = (np.arange(n)[:, None] + np.array([1, n // 2])) % n  # keeps the graph in one piece
        self.links = np.hstack([near, ring])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of up to ``width`` near centroids of each row, nearest first; -1 and inf where there are fewer."""
        width, step = min(width, len(self.c)), max(1, CELLS // len(self.c))
        parts = [self._best_first(x[i:i + step], width) for i in range(0, len(x), step)]
        return tuple(np.vstack(p) for p in zip(*parts, strict=True)) if parts else (np.zeros((0, width), int), np.zeros((0, width)))

    def _best_first(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The pool of a row holds the ``width`` nearest centroids seen; its nearest one not yet expanded is, until none is left."""
        b, norms = len(x), (x**2).sum(1)[:, None]
        seen = np.zeros((b, len(self.c)), bool)
        seen[:, self.entries] = True
        d = _distances(x, self.c[self.entries])
        first = np.argsort(d, axis=1, kind="stable")[:, :width]
        pool, dist = np.full((b, width), -1), np.full((b, width), np.inf)
        pool[:, :first.shape[1]], dist[:, :first.shape[1]] = self.entries[first], np.take_along_axis(d, first, 1)
        todo, active = pool >= 0, np.arange(b)
        while len(active):
            best = np.where(todo[active], dist[active], np.inf).argmin(1)
            go = todo[active, best]
            active, best = active[go], best[go]
            todo[active, best] = False
            around = self.links[pool[active, best]]
            fresh = ~seen[active[:, None], around]
            seen[active[:, None], around] = True
            d = np.maximum(norms[active] + self.squares[around] - 2 * np.einsum("bd,bld->bl", x[active], self.c[around]), 0)
            twice = (around[:, :, None] == around[:, None, :]) & np.tri(around.shape[1], k=-1, dtype=bool)  # a link named before
            d = np.where(fresh & ~twice.any(2), d, np.inf)
            all_d = np.hstack([dist[active], d])
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[active] = np.take_along_axis(all_d, keep, 1)
            pool[active] = np.take_along_axis(np.hstack([pool[active], around]), keep, 1)
            todo[active] = np.take_along_axis(np.hstack([todo[active], np.isfinite(d)]), keep, 1)
        return np.where(np.isinf(dist), -1, pool), np.sqrt(dist)

    def within(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """Of each row the centroids at most ``1 + ratio`` times as far as its nearest: from near ones along links, all at a time, while new ones come."""
        out: list[np.ndarray] = []
        step = max(1, CELLS // len(self.c))
        for i in range(0, len(x), step):
            part = x[i:i + step]
            at, d = self._best_first(part, min(WIDTH, len(self.c)))
            reach = (d[:, 0] * (1 + ratio)) ** 2 + 1e-12
            norms, seen = (part**2).sum(1), np.zeros((len(part), len(self.c)), bool)
            inside = np.zeros_like(seen)
            r, j = np.nonzero((at >= 0) & (d**2 <= reach[:, None]))
            c = at[r, j]
            seen[r, c] = inside[r, c] = True
            while len(r):
                pairs = np.unique((r[:, None] * len(self.c) + self.links[c]).ravel())
                pairs = pairs[~seen.ravel()[pairs]]
                r, c = np.divmod(pairs, len(self.c))
                seen[r, c] = True
                d2 = np.concatenate([norms[r[k:k + 65_536]] + self.squares[c[k:k + 65_536]]
                                     - 2 * np.einsum("md,md->m", part[r[k:k + 65_536]], self.c[c[k:k + 65_536]]) for k in range(0, len(r), 65_536)] or [np.zeros(0)])
                good = d2 <= reach[r]
                r, c = r[good], c[good]
                inside[r, c] = True
            out += [np.flatnonzero(row) for row in inside]
        return out


class Best:
    """The best ``k`` classes of each query of a block, among those that share a list with it, while classes come in batches."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, reads: list[np.ndarray], k: int):
        self.ids, self.y, self.k = ids, queries, k
        flat, rows = np.concatenate(reads), np.repeat(np.arange(len(ids)), [len(r) for r in reads])
        self.named = np.unique(flat)
        self.reads = np.zeros((len(self.named) + 1, len(ids)), bool)  # the last row stands for lists that no query reads
        self.reads[np.searchsorted(self.named, flat), rows] = True
        self.row, self.cid, self.first, self.score = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, cid: np.ndarray, first: np.ndarray, x: np.ndarray, lists: list[np.ndarray]) -> None:
        flat, sizes = np.concatenate(lists), np.array([len(c) for c in lists])
        at = np.searchsorted(self.named, flat)
        at[self.named[np.minimum(at, len(self.named) - 1)] != flat] = len(self.named)
        keep = np.logical_or.reduceat(self.reads[at], np.cumsum(sizes) - sizes)
        approx = np.where(keep, x @ self.y.T, -np.inf)
        beats = lambda cut: keep & ~(approx < cut - 1e-9 * (1 + np.abs(cut)))
        good = beats(self.least)
        if len(cid) > self.k and np.count_nonzero(good) > 4 * self.k * len(self.ids):
            good = beats(np.maximum(self.least, np.partition(approx, -self.k, axis=0)[-self.k]))
        c, r = np.nonzero(good)
        score = np.concatenate([(x[c[i:i + 65_536]] * self.y[r[i:i + 65_536]]).sum(axis=1) for i in range(0, len(r), 65_536)] or [np.zeros(0)])
        row, cid, first, score = (np.concatenate(p) for p in ((self.row, r), (self.cid, cid[c]), (self.first, first[c]), (self.score, score)))
        order = np.lexsort([first, -score, row])
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        self.least[row[place == self.k - 1]] = score[order][place[place < self.k] == self.k - 1]
        self.row, self.cid, self.first, self.score = row[place < self.k], cid[order], first[order], score[order]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.ids[self.row], "cid": self.cid, "first_id": self.first, "score": self.score})


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def lifted(vectors: pd.Series, norm: float, query: bool) -> np.ndarray:
    """Unit vectors whose distances rank inner products."""
    x = np.array(vectors.tolist(), np.float64)
    if query:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
    x = x / norm
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))])


def measured_ratio(classes: DataFrame, entries: DataFrame, graph: Graph, norm: float, k: int) -> float:
    """The least ratio at which the trial classes' lists hold the share ``AIM`` of their k neighbours, found by comparing them with all classes."""
    trials = classes.orderBy(F.xxhash64("embedding", F.lit(1)), "first_id").limit(TRIALS).select("cid", "embedding").toPandas()
    q, own = np.array(trials["embedding"].tolist(), np.float64), trials["cid"].to_numpy()

    def best(batches):
        cids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in batches:
            if len(b):
                cid = b["cid"].to_numpy()
                score = q @ np.array(b["embedding"].tolist(), np.float64).T
                score[own[:, None] == cid[None]] = -np.inf
                cids, scores = np.hstack([cids, np.tile(cid, (len(q), 1))]), np.hstack([scores, score])
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                cids, scores = np.take_along_axis(cids, at, 1), np.take_along_axis(scores, at, 1)
        yield pd.DataFrame({"trial": np.repeat(np.arange(len(q)), cids.shape[1]), "cid": cids.ravel(), "score": scores.ravel()})

    near = classes.select("cid", "embedding").mapInPandas(best, "trial int, cid long, score double").where("score > double('-infinity')")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "cid"))
    near = near.withColumn("place", place).where(F.col("place") <= k).select("trial", "cid")
    held = entries.select("cid", F.explode("lists").alias("list")).join(F.broadcast(near), "cid").toPandas()  # at most TRIALS * k * COPIES rows
    if not len(held):
        return 0.0
    d = np.sqrt(_distances(lifted(trials["embedding"], norm, True), graph.c))
    away = d[held["trial"], held["list"]] / np.maximum(d.min(1)[held["trial"]], 1e-12) - 1
    least = held.assign(away=away).groupby(["trial", "cid"])["away"].min()
    return float(np.quantile(least, AIM, method="higher"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    rows = usable(vectors)
    classes, members = classes_of(rows, k)
    n = classes.count()
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = float(np.sqrt(classes.select(F.max(squares).alias("m")).first()["m"] or 1.0)) * (1 + 1e-12)
    lists = int(np.clip(n // LIST_SIZE, 1, MOST_LISTS))
    size = max(LEAST_SAMPLE, PER_LIST * lists)
    sample = classes.orderBy(F.xxhash64("embedding"), "first_id").limit(size).select("embedding").toPandas()
    graph = Graph(list_centroids(lifted(sample["embedding"], norm, False), lists) if n else np.zeros((1, 1)))
    cell_of = cells_of(graph.c)
    n_cells = int(cell_of.max()) + 1

    def homes(v: pd.Series) -> list[np.ndarray]:
        at, d = graph.nearest(lifted(v, norm, False), 32)
        at, d = at[:, :COPIES], d[:, :COPIES]
        return [a[u] for a, u in zip(at, (at >= 0) & (d <= d[:, :1] * (1 + CLOSURE) + 1e-9), strict=True)]

    def listed(batches):
        for b in batches:
            if len(b):
                yield b.assign(lists=homes(b["embedding"]))

    rows_of = classes.select("cid", "first_id", "embedding")
    entries = stored(rows_of.mapInPandas(listed, T.StructType([*rows_of.schema.fields, *T.StructType.fromDDL("lists array<int>").fields])), "posting-lists")
    sizes = entries.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    sizes = {r["list"]: r["n"] for r in sizes.collect()}  # at most 2 * MOST_LISTS rows
    held = np.array([sizes.get(i, 0) for i in range(len(graph.c))])

    ratio = measured_ratio(classes, entries, graph, norm, k) if n else 0.0
    enough = COPIES * (k + 1)

    def probes(v: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
        """The lists that queries read, and the cells of their nearest ones."""
        x, out = lifted(v, norm, True), []
        at, _ = graph.nearest(x, WIDTH)
        for near, first in zip(graph.within(x, ratio), at, strict=True):
            if held[near].sum() < enough:
                first = first[first >= 0]
                near = np.union1d(near, first[np.cumsum(held[first]) - held[first] < enough])
            out.append(near if held[near].sum() >= enough else np.arange(len(held)))  # lists too thin: all
        return out, cell_of[at[:, 0]]

    def probed(batches):
        for b in batches:
            if len(b):
                reads, home = probes(b["query"])
                yield b.assign(reads=reads, home=home)

    query_rows = rows.where(F.col("vec_id") % every == 0).distinct().join(classes, "embedding").select("cid", F.col("vec_id").alias("query_id"))
    query_rows = stored(query_rows, "queries")
    queries = classes.join(query_rows.select("cid").distinct(), "cid", "left_semi")
    queries = queries.select(F.col("cid").alias("qid"), F.col("embedding").alias("query"))
    queries = stored(queries.mapInPandas(probed, T.StructType([*queries.schema.fields, *T.StructType.fromDDL("reads array<int>, home int").fields])), "probes")

    at_home = {r["home"]: r["n"] for r in queries.groupBy("home").agg(F.count("*").alias("n")).collect()}  # one row a cell
    first, parts = query_blocks(np.array([at_home.get(c, 0) for c in range(n_cells)]), QUERY_BLOCK)
    n_blocks = int((first + parts).max())
    of_home = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(n_cells)], "home int, first int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts"))).cast("int").alias("block")
    queries = queries.join(F.broadcast(of_home), "home").select(block, "qid", "query", "reads")

    def cells_read(batches):
        for b in batches:
            if len(b):
                cells = cell_of[np.concatenate(b["reads"].tolist())]
                pairs = np.unique(np.repeat(b["block"].to_numpy(np.int64), b["reads"].map(len)) * n_cells + cells)
                yield pd.DataFrame({"block": pairs // n_cells, "cell": pairs % n_cells})

    reading = np.zeros((n_cells, n_blocks), bool)
    for r in queries.select("block", "reads").mapInPandas(cells_read, "block int, cell int").distinct().collect():  # at most a row for each block and cell
        reading[r["cell"], r["block"]] = True

    def routed(batches):
        for b in batches:
            if len(b):
                sizes = b["lists"].map(len).to_numpy()
                to = np.logical_or.reduceat(reading[cell_of[np.concatenate(b["lists"].tolist())]], np.cumsum(sizes) - sizes)
                yield b.assign(blocks=[np.flatnonzero(t) for t in to])

    left = entries.mapInPandas(routed, T.StructType([*entries.schema.fields, *T.StructType.fromDDL("blocks array<int>").fields]))
    stripe = F.pmod(F.xxhash64("cid"), F.lit(STRIPES)).cast("int").alias("stripe")
    left = left.select(F.explode("blocks").alias("block"), stripe, F.lit(1).alias("kind"), F.col("cid").alias("id"), "first_id", "embedding", "lists")
    stripe = F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))).alias("stripe")
    none = F.lit(0).cast(classes.schema["first_id"].dataType).alias("first_id")
    right = queries.select("block", stripe, F.lit(0).alias("kind"), F.col("qid").alias("id"), none, F.col("query").alias("embedding"), F.col("reads").alias("lists"))

    def best(batches):
        """Of each block and stripe, its queries come first, then its classes."""
        key, waiting, pool = None, [], None
        for b in batches:
            tags = b[["block", "stripe", "kind"]].to_numpy()
            for at in np.split(np.arange(len(b)), np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1 if len(b) else []):
                if not len(at):
                    continue
                part, tag = b.iloc[at], tuple(tags[at[0]])
                if tag[:2] != key:
                    if pool:
                        yield pool.rows()
                    key, waiting, pool = tag[:2], [], None
                if tag[2] == 0:
                    waiting.append(part)
                    continue
                if pool is None:
                    q = pd.concat(waiting)
                    pool, waiting = Best(q["id"].to_numpy(), matrix(q["embedding"]), q["lists"].tolist(), k + 1), []
                pool.add(part["id"].to_numpy(), part["first_id"].to_numpy(), matrix(part["embedding"]), part["lists"].tolist())
        if pool:
            yield pool.rows()

    fields = T.StructType([T.StructField("qid", T.LongType()), T.StructField("cid", T.LongType()), classes.schema["first_id"], T.StructField("score", T.DoubleType())])
    dealt = left.unionByName(right).repartition("block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    found = dealt.mapInPandas(best, fields)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first_id")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("qid", "cid", "score")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = top.join(members, "cid").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    out = query_rows.withColumnRenamed("cid", "qid").join(top.select("qid", "vec_id", "score"), "qid").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
