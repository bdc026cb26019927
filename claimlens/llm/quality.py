"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics come from the whole text: sizes, shares of kinds of bytes, repetition of words, word pairs and lines,
word lengths. Training uses at most ``SAMPLE`` rows of each label value (labels of the training folds only); each tree
grows level by level on histograms of ``BINS`` quantile bins. The finished trees are flattened into arrays of feature,
threshold, children and value, and a batch of documents walks all trees at once, one array step a level.

Documents are scored where they lie: one scan, no shuffle. Only the sample's statistics reach the driver.

Defined results: a null or empty text has statistics 0 and gets their score. Without usable labels of both values every
score is the share of label 1 among those there are (0.5 if none). Repeated rows and null ids are scored like any other; a null id
is not held out. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .learning import held_out, labelled_texts

SAMPLE = 10_000
BINS, TREES, DEPTH, RATE, LEAST = 64, 60, 4, 0.15, 8
THRESHOLD = 0.3

NAMES = (
    "bytes", "words", "lines", "upper", "digits", "marks", "symbols", "pipes", "exclamations", "not_ascii", "spaces", "byte_entropy",
    "word_length", "long_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_lines", "short_lines",
    "line_words", "ends_closed", "capital_words", "marked_words", "longest_word",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of ``NAMES`` for one text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / len(raw)
    seen = share[share > 0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = len(words), len(lines)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lowered = raw.lower().split()
    line_sizes = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, m)
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(m), share[65:91].sum(), share[48:58].sum(),
        share[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum(), share[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 126]].sum(),
        share[124] + share[9], share[33], share[128:].sum(), share[32] + share[10], -(seen * np.log2(seen)).sum(),
        sizes.mean(), (sizes > 20).mean(), len(set(lowered)) / n, max(Counter(lowered).values()) / n,
        sum(map(eq, lowered, lowered[1:])) / n, len(set(zip(lowered, lowered[1:]))) / max(1, n - 1), len(set(lines)) / m,
        (line_sizes < 4).mean(), line_sizes.mean(), sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
        sum(map(bytes.isupper, words)) / n, sum(not w.isalpha() and w.isascii() for w in words) / n, np.log1p(sizes.max()),
    ]


@dataclass
class Trees:
    """Flattened trees; a leaf is its own child and its threshold is never read."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of the given rows, from one histogram for each feature."""
    n_rows, n = bins.shape
    flat = (bins + np.arange(n) * BINS).ravel()
    shape = (n, BINS)
    sums = [np.cumsum(np.bincount(flat, np.repeat(v, n) if v is not None else None, n * BINS).reshape(shape), axis=1) for v in (g, h, None)]
    gl, hl, nl = sums
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n_rows - nl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(nl < least) | (nr < least)] = -1
    f, b = np.unravel_index(np.argmax(gain), shape)
    return float(gain[f, b]), int(f), int(b)


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST) -> Trees:
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        one = np.zeros(1, np.int64)
        return Trees(float(np.log(p / (1 - p))), one, one, np.zeros(1), one, one, np.zeros(1), 0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    node: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        at = len(node["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            node[k].append(v)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        level = [(add(0.0), np.arange(len(y)))]
        roots.append(level[0][0])
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                gain, f, b = best_split(bins[rows], g[rows], h[rows], least) if d < depth and len(rows) >= 2 * least else (0.0, 0, 0)
                if gain <= 1e-6 or b >= len(cuts[f]):
                    node["value"][at] = rate * g[rows].sum() / (h[rows].sum() + 1)
                    margin[rows] += node["value"][at]
                    continue
                goes = bins[rows, f] <= b
                node["feature"][at], node["threshold"][at] = f, cuts[f][b]
                node["left"][at], node["right"][at] = add(0.0), add(0.0)
                below += [(node["left"][at], rows[goes]), (node["right"][at], rows[~goes])]
            level = below
    return Trees(base, np.array(roots), *(np.array(node[k]) for k in ("feature", "threshold", "left", "right", "value")), depth)


def with_statistics(docs: DataFrame, extra: str = "") -> DataFrame:
    """``extra`` columns and stats (array of double) of each row."""
    kept = [c for c in (extra,) if c]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(stats, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    rows = with_statistics(labelled_texts(docs, labels, label, sample), "label").toPandas()
    order = np.lexsort([*np.array(rows["stats"].tolist()).reshape(len(rows), -1).T, rows["label"]]) if len(rows) else []
    x = np.array(rows["stats"].tolist()).reshape(len(rows), -1)[order] if len(rows) else np.empty((0, len(NAMES)))
    return fit_trees(x, rows["label"].to_numpy(float)[order] if len(rows) else np.empty(0))


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score: one row per document row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    out = scores(docs, fit(docs, labels, sample=sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
