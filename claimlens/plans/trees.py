"""Boosted trees as flat node arrays: a model that scores, saves and tells its running scores by round.

A tree is a run of nodes; ``left`` and ``right`` are node numbers, a leaf points to itself. The margin of a row after
round i adds up the leaf values of the first i trees; the probability is its logistic. Rows are walked in numpy, all rows of an
Arrow batch at once, over only those vector slots that some tree reads.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.sparse import DENSE

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"
SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
LEAF = re.compile(r"^( *)Predict: (\S+)$")


@dataclass
class Trees:
    """``root``: each tree's first node; a row goes left where its feature is at most the threshold."""
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(trees: Sequence[Sequence[tuple]]) -> Trees:
        """From lists of (feature, threshold, left, right, value); children are numbered within their tree, leaves have None there."""
        root, rows = [], []
        for tree in trees:
            at = len(rows)
            root.append(at)
            for k, (feature, threshold, left, right, value) in enumerate(tree):
                leaf = left is None
                rows.append((0 if leaf else feature, 0.0 if leaf else threshold, at + (k if leaf else left), at + (k if leaf else right), value if leaf else 0.0))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return Trees(np.array(root, np.int64), np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64),
                     np.array(cols[3], np.int64), np.array(cols[4], float))

    def __len__(self) -> int:
        return len(self.root)

    def slots(self) -> np.ndarray:
        """The vector slots that inner nodes read."""
        return np.unique(self.feature[self.left != np.arange(len(self.left))])

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Leaf values, rows by trees; ``x`` holds the columns of ``slots``."""
        slots = self.slots()
        column = np.searchsorted(slots, self.feature)
        out = np.zeros((len(x), len(self)))
        for t, root in enumerate(self.root):
            at = np.full(len(x), root)
            inner = np.flatnonzero(self.left[at] != at)
            while len(inner):
                here = at[inner]
                at[inner] = np.where(x[inner, column[here]] <= self.threshold[here], self.left[here], self.right[here])
                inner = inner[self.left[at[inner]] != at[inner]]
            out[:, t] = self.value[at]
        return out


def parsed(debug: str, slots: Sequence[int]) -> list[list]:
    """Nodes [feature, threshold, left, right, value] of a fitted tree's text form, in the order in which its leaves are numbered."""
    nodes: list[list] = []
    open_: list[tuple[int, int]] = []  # (depth, inner node) whose right side follows
    for line in debug.splitlines():
        split, leaf = SPLIT.match(line), LEAF.match(line)
        if split and split[2] == "Else":
            depth = len(split[1])
            while open_[-1][0] != depth:
                open_.pop()
            nodes[open_[-1][1]][3] = len(nodes)
        elif split:
            open_.append((len(split[1]), len(nodes)))
            nodes.append([slots[int(split[3])], float(split[5]), len(nodes) + 1, -1, 0.0])
        elif leaf:
            nodes.append([None, None, None, None, float(leaf[2])])
    return nodes


def margin_arrays(rows: DataFrame, trees: Trees, rounds: Sequence[int], features: str = "features") -> Column:
    """array<double>: the margin after each of ``rounds`` (1-based numbers of trees, ascending)."""
    slots = trees.slots()
    at = np.array(rounds, np.int64) - 1

    @F.pandas_udf("array<double>")
    def margins(v: pd.DataFrame) -> pd.Series:
        x = picked(v, slots)
        sums = np.cumsum(trees.outputs(x), axis=1)[:, at] if len(at) else np.zeros((len(v), 0))
        return pd.Series(list(sums))

    return margins(F.unwrap_udt(F.col(features)))


def picked(v: pd.DataFrame, slots: np.ndarray) -> np.ndarray:
    """The values of ``slots`` (ascending) from unwrapped vectors, sparse or dense; slots beyond a vector would be an error of the caller."""
    x = np.zeros((len(v), len(slots)))
    dense = (v["type"] == DENSE).to_numpy()
    for i in np.flatnonzero(dense) if len(slots) else ():
        x[i] = v["values"].iloc[i][slots]
    rows = np.flatnonzero(~dense)
    if len(rows) and len(slots):
        indices, values = v["indices"].iloc[rows], v["values"].iloc[rows]
        held = np.concatenate(list(indices)).astype(np.int64)
        place = np.minimum(np.searchsorted(slots, held), len(slots) - 1)
        read = slots[place] == held
        x[np.repeat(rows, [len(i) for i in indices])[read], place[read]] = np.concatenate(list(values))[read]
    return x


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


class BoostedTreesModel(Model, HasFeaturesCol, HasProbabilityCol, MLWritable, MLReadable):
    """Adds ``probability`` (of label 1, double) from ``features``; written as Parquet nodes beside its parameters."""

    def __init__(self, trees: Trees | None = None):
        super().__init__()
        self.trees = trees

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.trees is None:
            raise ValueError("the model holds no trees: fit or load it first")
        if not len(self.trees):
            return dataset.withColumn(self.getProbabilityCol(), F.lit(0.5))
        margin = margin_arrays(dataset, self.trees, [len(self.trees)], self.getFeaturesCol())
        return dataset.withColumn(self.getProbabilityCol(), logistic(F.element_at(margin, 1)))

    def copy(self, extra=None) -> BoostedTreesModel:
        new = super().copy(extra)
        new.trees = self.trees
        return new

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        t, spark = self.model.trees, self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        tree = np.searchsorted(t.root, np.arange(len(t.feature)), "right") - 1
        rows = zip(tree.tolist(), range(len(tree)), t.feature.tolist(), t.threshold.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist(), strict=True)
        spark.createDataFrame(list(rows), NODES).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("node").toPandas()  # the model itself
        root = nodes.groupby("tree")["node"].min().to_numpy(np.int64)
        model = self.cls(Trees(root, *(nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
