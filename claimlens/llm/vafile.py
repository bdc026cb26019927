"""Clustering around centroids, with assignments looked up in a VA-file.

1. Vectors become integers, floor(64 * x) for each component, and are stored once together with their approximation: for each dimension the
   number of one of ``2 ** BITS`` cells, and the exact squared norm. Cell bounds are spread evenly between a dimension's least and largest value.
2. For a set of centroids, tables give every cell's least and largest part of the distance (its square is known from
   the norm: only -2 x c + c^2 is open). Added up over the dimensions they bound the distance to each centroid.
3. A vector whose interval for one centroid lies below all others is assigned from the approximation. Only where
   intervals overlap (or touch, since ties go to the smaller number) the full vector is fetched, and only the overlapping centroids are measured.
4. Sums of clusters are carried from round to round: only vectors that have moved are fetched for them. The first assignment,
   where all move, and the last, which returns every distance, read the whole table; those between scan the cells
   (Parquet reads those columns alone) and join the vectors to be fetched by row number.

What a task sends is its sums by cluster; the driver sees ``k`` centroids of one length. All arithmetic is on 64-bit integers.

Defined results: rows whose vector is null, has another length than ``dims``, or holds a null or non-finite component are left out.
Repeated rows and null ids are vectors like any other, only that null ids start no cluster; of vectors under one id
the smaller starts the earlier cluster, and equal ones leave the later empty. Fewer vectors than ``k`` give as many centroids; without any id
there is one centroid at the origin. An empty table gives an empty result. A component of 2^20 or more in size raises an error, since
squared distances would leave 64 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

DIMS, CLUSTERS, ROUNDS, STEPS = 64, 16, 3, 64
BITS = 6
MOST = 1 << 20


def whole_numbers(vectors: DataFrame, dims: int, steps: int) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part."""
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(sound)
    small = F.assert_true(F.forall("embedding", lambda e: F.abs(e) < MOST), F.lit(f"a component has a size of {MOST} or more"))
    rows = rows.where(small.isNull())
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * steps).cast("long")).alias("x"))


class Cells:
    """Evenly spread cells of each dimension between its least and largest value."""

    def __init__(self, least: np.ndarray, most: np.ndarray, bits: int):
        self.bits, n = bits, 1 << bits
        self.edges = least + (most - least + 1) * np.arange(n + 1)[:, None] // n  # cell i holds edges[i] <= x < edges[i + 1]
        self.low, self.high = self.edges[:-1], np.maximum(self.edges[1:] - 1, self.edges[:-1])

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers, one byte each."""
        return np.stack([np.searchsorted(self.edges[1:, j], x[:, j], "right") for j in range(x.shape[1])], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """By dimension and cell: the least value of c^2 - 2 x c for each centroid, then the largest for each."""
        c = centroids.T[:, None, :]
        ends = np.stack([c * c - 2 * end.T[:, :, None] * c for end in (self.low, self.high)])
        return np.concatenate([ends.min(0), ends.max(0)], axis=2)


def packed_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers in ``bits`` bits each, one row of bytes a vector."""
    flags = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:]
    return np.packbits(flags.reshape(len(cells), -1), axis=1)


def unpacked_bits(raw: np.ndarray, dims: int, bits: int) -> np.ndarray:
    flags = np.unpackbits(raw, axis=1, count=dims * bits).reshape(len(raw), dims, bits)
    return np.packbits(np.concatenate([np.zeros((len(raw), dims, 8 - bits), np.uint8), flags], axis=2), axis=2)[:, :, 0]


def fixed(column: pa.Array, dtype: type) -> np.ndarray:
    """The values of a binary column whose values have one size, as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def intervals(cells: np.ndarray, norm: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distance of each vector (rows) to each centroid (columns)."""
    out = np.repeat(norm[:, None], tables.shape[2], axis=1)
    for j, table in enumerate(tables):
        out += table[cells[:, j]]
    return out[:, :out.shape[1] // 2], out[:, out.shape[1] // 2:]


def candidates(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The centroids whose interval reaches down to the least upper bound."""
    return low <= high.min(1)[:, None]


def open_centroids(batch: pa.RecordBatch, tables: np.ndarray, bits: int) -> np.ndarray:
    """The candidates of a batch whose columns ``cells`` and ``norm`` hold the approximation."""
    cells = unpacked_bits(fixed(batch.column("cells"), np.uint8), len(tables), bits)
    return candidates(*intervals(cells, batch.column("norm").to_numpy(zero_copy_only=False), tables))


def measured(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance): exact, over the open centroids of each row only."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, c])
        d = ((x[rows] - centroid) ** 2).sum(1)
        less = d < best[rows]
        best[rows[less]], at[rows[less]] = d[less], c
    return at, best


MOVED = T.StructType([T.StructField("rid", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("fetch", T.BooleanType()),
                      T.StructField("open", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """By cluster: the members' sum in each dimension, then their number."""
    return np.array([[*x[at == c].sum(0), (at == c).sum()] for c in range(k)], np.int64).reshape(k, x.shape[1] + 1)


def _batch(rid, cluster, fetch, open_, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(cluster, pa.int32()), pa.array(fetch, pa.bool_()), pa.array(open_, pa.int64()),
                                       pa.array(sums, pa.list_(pa.int64()))], names=MOVED.names)


def _rows(rid: np.ndarray, cluster: np.ndarray, fetch: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    return _batch(rid, cluster, fetch, open_, [None] * len(rid))


def _total(sums: np.ndarray) -> pa.RecordBatch:
    """A task's sums, one row for each cluster."""
    n = len(sums)
    return _batch([None] * n, range(n), [None] * n, [None] * n, sums.tolist())


def _added(parts: DataFrame, k: int, dims: int) -> np.ndarray:
    """All tasks' sums: at most k * (dims + 1) rows reach the driver."""
    cells = parts.where("sums is not null").select("cluster", F.posexplode("sums").alias("j", "v")).groupBy("cluster", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k, dims + 1), np.int64)
    for r in cells.collect():
        out[r["cluster"], r["j"]] = r["v"]
    return out


class VaFile:
    """Stored vectors with their approximations: rid, vec_id, cells, norm, x."""

    def __init__(self, rows: DataFrame, dims: int, bits: int):
        self.dims, self.bits = dims, bits
        rows = stored(rows, "whole-vectors")
        ends = [g(F.col("x")[j]).alias(f"{name}{j}") for j in range(dims) for name, g in (("lo", F.min), ("hi", F.max))]
        r = rows.agg(*ends).first()
        least, most = (np.array([r[f"{name}{j}"] or 0 for j in range(dims)], np.int64) for name in ("lo", "hi"))
        self.cells = cells = Cells(least, most, bits)
        schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("cells", T.BinaryType()),
                               T.StructField("norm", T.LongType()), T.StructField("x", T.BinaryType())])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                cell = packed_bits(cells.of(x), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([c.tobytes() for c in cell], pa.binary()), pa.array((x * x).sum(1), pa.int64()),
                     pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())], names=schema.names)

        built = rows.mapInArrow(build, schema)
        self.table = stored(built.withColumn("rid", F.monotonically_increasing_id()), "va-file")

    def first(self, centroids: np.ndarray) -> DataFrame:
        """Assigns every vector and adds up the clusters; reads the whole table."""
        k, bits, tables = len(centroids), self.bits, self.cells.tables(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                open_ = open_centroids(batch, tables, bits)
                x = fixed(batch.column(3), np.int32).astype(np.int64)
                at = open_.argmax(1)
                many = np.flatnonzero(open_.sum(1) > 1)
                at[many] = measured(x[many], centroids, open_[many])[0]
                total = total + _sums(x, at, k)
                yield _rows(batch.column(0), at, np.ones(len(at), bool), np.zeros(len(at), np.int64))
            if not isinstance(total, int):
                yield _total(total)

        return stored(self.table.select("rid", "cells", "norm", "x").mapInArrow(run, MOVED), "assigned")

    def next(self, centroids: np.ndarray, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rid, cluster of all vectors; rows with the sums to be added): scans the cells, fetches open and moved vectors."""
        k, bits, tables = len(centroids), self.bits, self.cells.tables(centroids)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                open_ = open_centroids(batch, tables, bits)
                was, at = batch.column(3).to_numpy(zero_copy_only=False), open_.argmax(1)
                many = open_.sum(1) > 1
                marks = (open_ * (1 << np.arange(k, dtype=np.int64))).sum(1)
                yield _batch(batch.column(0), at, many | (at != was), marks, [None] * len(at))

        known = before.where("rid is not null").select("rid", F.col("cluster").alias("was"))
        cells = self.table.select("rid", "cells", "norm").join(known, "rid")
        looked = stored(cells.select("rid", "cells", "norm", "was").mapInArrow(look, MOVED).select("rid", "cluster", "fetch", "open"), "looked-up")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, centroids.shape[1] + 1), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                open_ = (batch.column(1).to_numpy(zero_copy_only=False)[:, None] >> np.arange(k)) & 1 == 1
                x = fixed(batch.column(2), np.int32).astype(np.int64)
                was, at = batch.column(3).to_numpy(zero_copy_only=False), measured(x, centroids, open_)[0]
                moved = at != was
                total += _sums(x[moved], at[moved], k) - _sums(x[moved], was[moved], k)
                yield _rows(batch.column(0), at, np.ones(len(at), bool), np.zeros(len(at), np.int64))
            if total.any():
                yield _total(total)

        wanted = looked.where("fetch").select("rid", "open").join(self.table.select("rid", "x"), "rid").join(known, "rid")
        fetched = stored(wanted.select("rid", "open", "x", "was").mapInArrow(fetch, MOVED), "fetched")
        same = looked.where("not fetch").select("rid", "cluster")
        return same.unionByName(fetched.where("rid is not null").select("rid", "cluster")), fetched

    def distances(self, centroids: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance of every vector."""
        bits, tables = self.bits, self.cells.tables(centroids)
        schema = T.StructType([self.table.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                open_ = open_centroids(batch, tables, bits)
                at, d = measured(fixed(batch.column(3), np.int32).astype(np.int64), centroids, open_)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=schema.names)

        return stored(self.table.select("vec_id", "cells", "norm", "x").mapInArrow(run, schema), "distances")


def starts(rows: DataFrame, k: int, dims: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of ``1:<vec_id>``."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").orderBy(order, "x").limit(k).collect()
    return np.array([r["x"] for r in first] or [[0] * dims], np.int64)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, steps: int = STEPS, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array of long)."""
    if not 1 <= bits <= 8 or not 1 <= k <= 62:
        raise ValueError("bits must be 1 to 8, k 1 to 62")
    rows = whole_numbers(vectors, dims, steps)
    centroids = starts(rows, k, dims)
    file = VaFile(rows, dims, bits)
    state = None
    for _ in range(rounds):
        if state is None:
            state = file.first(centroids)
            sums = _added(state, len(centroids), dims)
        else:
            state, moved = file.next(centroids, state)
            sums = sums + _added(moved, len(centroids), dims)
        n = sums[:, -1:]
        centroids = np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centroids)
    found = file.distances(centroids)
    spark = vectors.sparkSession
    final = [(c, [int(v) for v in x]) for c, x in enumerate(centroids)]
    named = spark.createDataFrame(final, "cluster int, centroid array<long>")  # k rows
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    total = found.agg(F.coalesce(F.sum("distance"), F.lit(0)).alias("s")).first()["s"]
    of_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(named, "cluster")
    of_cluster = of_cluster.select("cluster", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), digest.alias("centroid_sha256"), "centroid")
    return found.join(F.broadcast(of_cluster), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
