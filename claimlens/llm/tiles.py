"""Near copies among embeddings by PCA-ordered tiled comparison; exact.

1. Equal vectors form a class, compared once and counted with its weight.
2. Principal components of all unit vectors (of the most frequent length) turn the space so that the leading dimensions carry most.
3. A tree of cuts in the leading dimensions, fitted on a hash-ordered sample of ``SAMPLE`` classes, deals vectors into at most ``LEAVES``
   leaves of near vectors. The sample decides the balance alone: every leaf's box is taken from all its vectors, and leaves are cut by hash
   into blocks, so that no task holds more than two blocks. Pairs of leaves whose boxes lie too far apart for the threshold are left out.
4. A task compares two blocks, tile by tile. Over the first ``STEP`` dimensions it adds up products; what the rest can add is
   at most the product of the suffix norms (Cauchy-Schwarz). Pairs that cannot reach the threshold stop there, the others get the
   next dimensions. A pair within ``NEAR`` of the threshold is decided on the original vectors.
5. Pairs are not written: a task returns, for each vector with links, their weight and the root of its tree of links in that task.
   Sums give n_links; the trees' edges go to alternating large-star and small-star.

Work is that of comparing all pairs of blocks whose boxes meet: where vectors fill the space evenly, all of them.

Defined results: a null or zero vector, or one with a null or non-finite component, has no links. Vectors of different lengths have none either. Repeated
rows are vectors of their own: each links the others. component_id is the smallest id that is not null; kept compares null-safe, so a
null id by itself is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minhash import components

LEAST = 0.9
STEP = 16
SAMPLE, LEAVES = 32_768, 4096
SMALLEST, LARGEST = 2048, 32_768
TILE = 512
NEAR = 1e-9
LONGEST = 256
HOT_PARTS = 1024


def usable() -> Column:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("embedding").isNotNull() & sound & F.exists("embedding", lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def basis(classes: DataFrame, d: int) -> np.ndarray:
    """The principal components of all unit vectors of length d as columns, heaviest first; those longer than ``LONGEST`` are not turned."""
    if d > LONGEST:
        return np.eye(d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = unit(matrix(batch.column(0), d))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    parts = classes.where(F.size("embedding") == d).select("embedding").mapInArrow(moments, "i int, v array<double>")
    sums = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((d, d))
    for r in sums.collect():  # at most LONGEST ** 2 rows
        total[r["i"], r["j"]] = r["v"]
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def lead(x: np.ndarray) -> np.ndarray:
    """The first ``STEP`` dimensions and the norm of the others."""
    return np.column_stack([x[:, :STEP], np.sqrt((x[:, STEP:] ** 2).sum(1))])


class Tree:
    """Median cuts in the dimension that varies most; ``leaf`` is -1 at inner nodes."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.child, self.leaf = [0], [0.0], [0], [-1]
        parts = [(0, sample)]
        done = 0
        while parts:
            node, rows = parts.pop(0)
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(1)
            if done + len(parts) + 1 >= leaves or len(rows) < 16 or spread.max() == 0:
                self.leaf[node], done = done, done + 1
                continue
            j = int(rows.var(0).argmax())
            cut = float(np.median(rows[:, j]))
            left = rows[:, j] <= cut
            if left.all():
                cut = float(rows[:, j][rows[:, j] < cut].max())
                left = rows[:, j] <= cut
            self.dim[node], self.cut[node], self.child[node] = j, cut, len(self.dim)
            for side in (left, ~left):
                parts.append((len(self.dim), rows[side]))
                for column, value in ((self.dim, 0), (self.cut, 0.0), (self.child, 0), (self.leaf, -1)):
                    column.append(value)
        self.dim, self.cut, self.child, self.leaf = map(np.array, (self.dim, self.cut, self.child, self.leaf))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            here = at[inner]
            at[inner] = self.child[here] + (x[inner, self.dim[here]] > self.cut[here])


def near_boxes(low: np.ndarray, high: np.ndarray, k: int, least: float) -> np.ndarray:
    """The boxes from number k on that may hold a vector whose cosine with one of box k is at least ``least``."""
    gap = np.maximum(0, np.maximum(low[k:] - high[k], low[k] - high[k:]))
    return k + np.flatnonzero((gap * gap).sum(1) <= 2 - 2 * least + NEAR)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of 0 .. n - 1."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (label[u], label[v]):
            np.minimum.at(new, at, least)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


class Side:
    """A block: rows by their first component, turned vectors, norms of what follows each step."""

    def __init__(self, table: pa.Table, turn: np.ndarray | None):
        d = len(table["embedding"][0])
        raw = matrix(table["embedding"], d)
        x = unit(raw)
        x = x if turn is None or len(turn) != d else x @ turn
        order = np.argsort(x[:, 0], kind="stable")
        self.raw, self.x = raw[order], x[order]
        self.cid, self.weight = (table[c].to_numpy()[order] for c in ("cid", "weight"))
        self.steps = [*range(STEP, d, STEP), d]
        squares = self.x ** 2
        self.rest = [np.sqrt(squares[:, k:].sum(1)) for k in self.steps]
        head = lead(self.x)
        self.starts = range(0, len(self.x), TILE)
        self.low = [head[s:s + TILE].min(0) for s in self.starts]
        self.high = [head[s:s + TILE].max(0) for s in self.starts]


def linked(a: Side, b: Side, s: int, t: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of tile s of a and tile t of b with a cosine of at least ``least``; of one tile each pair once."""
    rows, cols = slice(s, s + TILE), slice(t, t + TILE)
    k = a.steps[0]
    x, y = np.column_stack([a.x[rows, :k], a.rest[0][rows]]), np.column_stack([b.x[cols, :k], b.rest[0][cols]])
    most = x @ y.T  # leading products, and the most that the rest can add
    i, j = np.nonzero(most >= least - NEAR)
    if same and s == t:
        i, j = i[i < j], j[i < j]
    total = most[i, j] - x[i, -1] * y[j, -1]
    i, j = i + s, j + t
    for n, k2 in enumerate(a.steps[1:], 1):
        if not len(i):
            break
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            total[part] += np.einsum("pd,pd->p", a.x[i[part], k:k2], b.x[j[part], k:k2])
        alive = total + a.rest[n][i] * b.rest[n][j] >= least - NEAR
        i, j, total, k = i[alive], j[alive], total[alive], k2
    doubtful = np.flatnonzero(np.abs(total - least) <= 2 * NEAR)
    if len(doubtful):
        x, y = a.raw[i[doubtful]], b.raw[j[doubtful]]
        x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
        total[doubtful] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    sure = total >= least
    return i[sure], j[sure]


def compared(left: pa.Table, right: pa.Table, turn: np.ndarray | None, least: float) -> pa.Table:
    """cid, n (weight of the links met here), root (of the tree of links met here) for each class with a link; an empty right side: left with itself."""
    out = {"cid": pa.int64(), "n": pa.int64(), "root": pa.int64()}
    empty = pa.schema(list(out.items())).empty_table()
    if not left.num_rows:
        return empty
    a = Side(left, turn)
    same = not right.num_rows
    b = a if same else Side(right, turn)
    cid = a.cid if same else np.concatenate([a.cid, b.cid])
    shift = 0 if same else len(a.cid)
    n, root = np.zeros(len(cid)), np.arange(len(cid))
    for p, s in enumerate(a.starts):
        for q, t in enumerate(b.starts):
            if same and t < s:
                continue
            gap = np.maximum(0, np.maximum(a.low[p] - b.high[q], b.low[q] - a.high[p]))
            if (gap * gap).sum() > 2 - 2 * least + NEAR:
                continue
            i, j = linked(a, b, s, t, least, same)
            if len(i):
                n += np.bincount(i, b.weight[j], len(cid)) + np.bincount(j + shift, a.weight[i], len(cid))
                root = forest(np.concatenate([np.arange(len(cid)), i]), np.concatenate([root, j + shift]), len(cid))
    at = np.flatnonzero(n)
    return pa.Table.from_arrays([pa.array(cid[at]), pa.array(n[at].astype(np.int64)), pa.array(cid[root[at]])], schema=empty.schema)


def block_pairs(leaves: DataFrame, block: int, least: float) -> DataFrame:
    """a, i, b, j: blocks i of leaf a and j of leaf b that are compared, each pair once."""
    spark = leaves.sparkSession
    boxes = leaves.where("leaf >= 0").orderBy("leaf").collect()  # at most LEAVES rows
    ids = np.array([r["leaf"] for r in boxes])
    low, high = (np.array([[x if x is not None else 0.0 for x in r[c]] for r in boxes]) for c in ("low", "high"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in np.searchsorted(ids, batch.column(0).to_numpy()):
                near = ids[near_boxes(low, high, k, least)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[k])), pa.array(near)], names=["a", "b"])

    own = leaves.where("leaf >= 0").select("leaf").repartition(max(1, min(200, len(ids) // 16))).mapInArrow(test, "a long, b long") if len(ids) else \
        spark.createDataFrame([], "a long, b long")
    pairs = own.unionByName(leaves.where("leaf < 0").select(F.col("leaf").alias("a"), F.col("leaf").alias("b")))
    blocks = leaves.select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    pairs = pairs.join(blocks.select(F.col("leaf").alias("a"), F.col("blocks").alias("n_a")), "a")
    pairs = pairs.join(blocks.select(F.col("leaf").alias("b"), F.col("blocks").alias("n_b")), "b")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    return pairs.where("a <> b or i <= j").select("a", "i", "b", "j")


def class_links(classes: DataFrame, least: float) -> DataFrame:
    """cid, n, root of the classes (cid, weight, embedding) with links, as met by each task."""
    spark = classes.sparkSession
    top = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    total, d = (top["n"], top["d"]) if top else (0, 0)
    if total > 1:
        turn = basis(classes, d)
        sample = classes.where(F.size("embedding") == d).orderBy(F.xxhash64("embedding"), "cid").limit(SAMPLE).select("embedding").toArrow()
        block = int(np.clip(total // 8, SMALLEST, LARGEST))
        tree = Tree(lead(unit(matrix(sample["embedding"], d)) @ turn), min(LEAVES, -(-total // block)))
    else:
        turn, block, tree = None, SMALLEST, None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                leaves, heads = np.full(part.num_rows, -int(size)), [None] * part.num_rows
                if tree is not None and size == d:
                    x = lead(unit(matrix(part.column(2), d)) @ turn)
                    leaves, heads = tree.leaf_of(x), x.tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.int64()), pa.array(heads, pa.list_(pa.float64()))],
                                                 names=["cid", "weight", "embedding", "leaf", "head"])

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("cid", "weight", "embedding").mapInArrow(deal, f"cid long, weight long, embedding {kind}, leaf long, head array<double>")
    dealt = stored(dealt, "leaves-of-vectors")
    width = min(d, STEP) + 1
    ends = [F.array(*(g(F.get("head", F.lit(k))) for k in range(width))).alias(name) for name, g in (("low", F.min), ("high", F.max))]
    leaves = stored(dealt.groupBy("leaf").agg(F.count("*").alias("n"), *ends), "leaves")
    pairs = stored(block_pairs(leaves, block, least), "block-pairs")
    blocks = leaves.select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = dealt.join(F.broadcast(blocks) if leaves.count() <= 2 * LEAVES else blocks, "leaf")
    rows = rows.select("cid", "weight", "embedding", "leaf", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"))
    keys = ["a", "i", "b", "j"]
    left = rows.withColumnsRenamed({"leaf": "a", "block": "i"}).join(pairs, ["a", "i"])
    right = rows.withColumnsRenamed({"leaf": "b", "block": "j"}).join(pairs.where("a <> b or i <> j"), ["b", "j"])

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        a, i, b, j = (k.as_py() for k in key)
        if (a, i) != (b, j) and not y.num_rows:
            y, x = x, x.slice(0, 0)
        return compared(x, y, turn, least)

    columns = [*keys, "cid", "weight", "embedding"]
    left, right = (side.select([F.col(c).alias(c) for c in columns]) for side in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "cid long, n long, root long")
    return stored(found, "links-of-vectors")


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    rows = vectors.select("vec_id", "embedding").withColumn("usable", usable())
    sound = rows.where("usable").select("vec_id", "embedding")
    classes = sound.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "embedding-classes")
    links = class_links(classes, least)
    direct = links.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = components(links.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(direct, "cid", "left")
    firsts = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(firsts, "comp").select("embedding", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", "weight")
    named = stored(named, "named-classes")
    n = named.agg(F.sum("weight").alias("n")).first()["n"] or 0
    hot = F.broadcast(named.where(F.col("weight") * HOT_PARTS > n).drop("weight"))  # fewer than HOT_PARTS rows
    cold = named.where(F.col("weight") * HOT_PARTS <= n).drop("weight")
    found = sound.join(hot, "embedding").unionByName(
        sound.join(hot.select("embedding"), "embedding", "left_anti").join(cold, "embedding")).drop("embedding")
    other = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", "n_links", "component_id").unionByName(other)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
