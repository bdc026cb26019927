"""MinHash near-duplicate groups: universal hash minima, banding, signature verification, components by stars.

A text's set is its distinct ``words``-word shingles (the whole sequence as one when it has fewer words); words are
runs of anything but white space, A-Z lower-cased. Two documents are linked when 100 * |A and B| >= percent * |A or B|.

1. Each document: set size, a 128-bit digest of the sorted set, and ``bands * rows`` minima of multiply-add hashes.
2. Documents with equal digests form a class; its smallest doc_id stands for it, so copies cost nothing further.
3. Banding: a class enters one bucket for each band of ``rows`` minima. With 32 bands of 4 minima a pair at
   similarity 0.75 shares no bucket with probability 5e-6. Every member of a bucket is paired with the bucket's hub, the class that shares
   buckets with most others (a star, linear in the bucket), signatures are compared, and pairs that pass are confirmed
   on the full sets.
4. Large-star and small-star steps alternate until nothing changes; they only join and aggregate.
5. Stars can miss a link between two members that are both unlike the hub. So each bucket that still holds
   several components is searched in full: its members are dealt into blocks, each pair of blocks is a group of bounded
   size, and members of different components whose signatures and sizes pass are confirmed there on their full sets. Only
   links that join components leave the task, so what is written never grows with the square of a bucket.

Verification by signature drops a pair only when its matching minima lie more than ``SIGMAS`` standard deviations below
the threshold; the exact test on full sets always decides.

Defined results: a null, empty or wordless text has n_shingles 0 and is linked with nothing (component_id = doc_id). Rows that
repeat a doc_id are returned each, grouped by their own texts. Null ids are returned with the smallest id of their
group (null if none) and kept = false. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, small_batches, stored

BANDS, ROWS = 32, 4
WORDS, PERCENT = 5, 75
SIGMAS = 5.0
BLOCK = 256
SEED = 20240607
KNOWN_WORDS = 200_000


def hash_words(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words (md5); ``known`` keeps those of words seen before."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(md5(w).digest()[:8], "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text (bytes: lower() and split() know ASCII only)."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = hash_words(found, known)
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else 0, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def universal(bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of minima (upper 32 bits of a * x + b modulo 2**64) for each non-empty set."""
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):  # blocks of about 32k shingles stay in cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32768):
            size += len(sets[end])
            end += 1
        if len(sets[at]) > 32768:
            for lo in range(0, len(sets[at]), 32768):
                x = sets[at][lo:lo + 32768]
                for i in range(len(a)):
                    out[at, i] = min(out[at, i], ((a[i] * x + b[i]) >> np.uint64(32)).min())
        else:
            x = np.concatenate(sets[at:end])
            starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
            for i in range(len(a)):
                out[at:end, i] = np.minimum.reduceat((a[i] * x + b[i]) >> np.uint64(32), starts)
        at = end
    return out


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest, sig (little-endian 32-bit minima; null for empty sets): one row per document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        a, b = universal(bands, rows)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingles(t.as_py(), known, words) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = minima([sets[i] for i in full], a, b) if full else None
                sig: list = [None] * len(sets)
                digest: list = [None] * len(sets)
                for k, i in enumerate(full):
                    sig[i], digest[i] = sigs[k].tobytes(), md5(sets[i].tobytes()).digest()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def distinct_sets(sigs: DataFrame) -> DataFrame:
    """Classes of documents with equal sets: cid, digest, first_id (smallest doc_id), n_shingles, sig."""
    classes = sigs.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def shared_buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """cid, key, size for each class and each of its buckets that holds other classes too."""
    width = 4 * rows
    keys = F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")
    all_keys = classes.select("cid", F.explode(keys).alias("key"))
    shared = all_keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(all_keys.join(shared, "key").select("cid", "key", "size"), "buckets")


def star_pairs(members: DataFrame) -> DataFrame:
    """a, b: each member of a bucket with the bucket's hub, the class that shares buckets with most others."""
    ranked = members.join(members.groupBy("cid").agg(F.sum("size").alias("degree")), "cid")
    hubs = ranked.groupBy("key").agg(F.max_by("cid", F.struct("degree", -F.col("cid"))).alias("hub"))
    pairs = members.join(hubs, "key").where("cid <> hub")
    return pairs.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()


def _close(left: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    """Whether the share of equal minima leaves similarity p possible."""
    m = left.shape[-1]
    return (left == right).sum(axis=-1) >= m * p - SIGMAS * (m * p * (1 - p)) ** 0.5


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose set sizes and signatures leave similarity ``percent`` possible."""

    @F.pandas_udf("boolean")
    def passes(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(x), np.uint32).reshape(len(x), -1)
        return pd.Series(_close(left, np.frombuffer(b"".join(y), np.uint32).reshape(len(y), -1), percent / 100))

    left = classes.select(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    right = classes.select(F.col("cid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(left, "a").join(right, "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.where(passes("sig_a", "sig_b")).select("a", "b")


def sets_of(classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """cid, items (sorted 64-bit shingle hashes) of the given classes, from the texts of their smallest ids."""
    wanted = classes.select("cid", F.col("first_id").alias("w_id"), F.col("digest").alias("w_digest"))
    ids = broadcast_if_small(wanted.select("w_id").distinct(), wanted.count(), 64)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("w_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                sets = [shingles(t.as_py(), known, words).tobytes() for t in batch.column(0).slice(lo, 64)]
                yield pa.RecordBatch.from_arrays([pa.array([md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                                                 names=["digest", "items"])

    sets = texts.mapInArrow(run, "digest binary, items binary").join(wanted, F.col("digest") == F.col("w_digest"))
    return stored(sets.groupBy("cid").agg(F.first("items").alias("items")), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with 100 * |A and B| >= percent * |A or B| on their full sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            left, right = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(left, right, assume_unique=True))
            out[i] = 100 * both >= percent * (len(left) + len(right) - both)
        return pd.Series(out)

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("items_a")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("items_b")), "b")
    return stored(both.where(linked("items_a", "items_b")).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """cid, comp (smallest cid reachable) for every class with a link, by alternating large-star and small-star."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(
                edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")


def group_links(group: list[tuple], apart: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components of a group of (cid, comp, blk, n_shingles, sig, items), confirmed on full sets.

    ``apart``: only members of different blocks are compared. Members that links have joined already are not compared again.
    """
    cid, label, blk, n = (np.array([g[k] for g in group]) for k in range(4))
    sig = np.frombuffer(b"".join(g[4] for g in group), np.uint32).reshape(len(group), -1)
    flags, number, starts = None, None, None
    out = []
    for x in range(len(group) - 1):
        y = np.arange(x + 1, len(group))
        y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent) & (blk[y] != blk[x] if apart else True)]
        y = y[_close(sig[y], sig[x], percent / 100)] if len(y) else y
        if not len(y):
            continue
        if flags is None:
            found, number = np.unique(np.frombuffer(b"".join(g[5] for g in group), np.uint64), return_inverse=True)
            flags, starts = np.zeros(len(found), bool), np.concatenate([[0], np.cumsum(n)])
        flags[number[starts[x]:starts[x + 1]]] = True
        for k in y:
            if label[k] != label[x]:
                both = int(flags[number[starts[k]:starts[k + 1]]].sum())
                if 100 * both >= percent * (n[x] + n[k] - both):
                    out.append((int(cid[x]), int(cid[k])))
                    label[label == label[k]] = label[x]
        flags[number[starts[x]:starts[x + 1]]] = False
    return out


def mixed_links(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components that share a bucket; see step 5 above."""
    labelled = members.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = labelled.join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("cid", "key"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("cid", "comp", "key", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    rows = dealt.join(classes.select("cid", "n_shingles", "sig"), "cid").join(sets, "cid")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], (0, 0, 0)

        def done() -> Iterator[pa.RecordBatch]:
            links = group_links(group, at[1] != at[2], percent) if len(group) > 1 else []
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "cid", "comp", "blk", "n_shingles", "sig", "items")]
            for key, i, j, *row in zip(*cols, strict=True):
                if (key, i, j) != at:
                    yield from done()
                    group, at = [], (key, i, j)
                group.append(tuple(row))
        yield from done()

    return stored(rows.mapInArrow(search, "a long, b long").distinct(), "more-links")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sigs = stored(signatures(docs, words, bands, rows), "signatures")
    classes = distinct_sets(sigs)
    members = shared_buckets(classes, bands, rows)
    shared = stored(classes.join(members.select("cid").distinct(), "cid", "left_semi"), "shared-classes")
    sets = sets_of(shared, docs, words)
    links = confirmed(alike(star_pairs(members), shared, percent), sets, percent)
    more = mixed_links(members, components(links), shared, sets, percent)
    comps = components(links.unionByName(more))
    grouped = classes.select("cid", "digest", "first_id").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    firsts = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(firsts, "comp").select(F.col("digest").alias("c_digest"), "component_id")
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("c_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
