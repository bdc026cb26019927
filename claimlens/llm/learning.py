"""What both classifiers share: the bounded sample of labelled training rows, and a logistic fit in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc_mod(F.col(doc_id), FOLDS) == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of training rows: at most ``bound`` of each label value, in the order of a hash of the id.

    Of rows that repeat an id one is used, that with the smallest text hash; so the sample is bounded in rows. Rows with a null id or label, or a label other than 0 and 1, are not used; of labels that contradict each other for one id the larger holds.
    """
    known = labels.where(f"doc_id is not null and {label} in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("label") == v).orderBy(order, "doc_id").limit(bound) for v in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "picked_id")
    # at most 2 * bound ids: a broadcast of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id"))
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return one.select("doc_id", "r.text", "label")


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients (the last one for the constant) by Newton steps on weighted rows."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        move = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return b
