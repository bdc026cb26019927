"""Sparse vectors as plain columns: ``struct<type, size, indices, values>``, the layout in which Spark stores its own
vectors, with only the occupied slots, in order.

Such columns can be shuffled, joined and written without a dense array, and ``stored_vectors`` reads them back as vectors for MLlib.
A zero is not an occupied slot; a null vector is not expected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import ensure_checkpoint_dir

SPARSE, DENSE = 0, 1  # Spark's marks of the two forms, fixed values


def sparse(vector: str) -> Column:
    """A vector column in sparse form, whichever form its rows have."""
    v = F.unwrap_udt(F.col(vector))
    slots = F.when(v["type"] == DENSE, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(v["indices"])
    held = F.filter(F.arrays_zip(slots.alias("i"), v["values"].alias("x")), lambda p: p["x"] != 0)
    return F.struct(
        F.lit(SPARSE).cast("tinyint").alias("type"),
        F.when(v["type"] == DENSE, F.size(v["values"])).otherwise(v["size"]).alias("size"),
        F.transform(held, lambda p: p["i"]).alias("indices"), F.transform(held, lambda p: p["x"]).alias("values"))


def stored_vectors(df: DataFrame, column: str) -> DataFrame:
    """``df`` written to the shared folder, its sparse ``column`` read back as a vector."""
    from claimlens.sources.sinks import work_dir
    ensure_checkpoint_dir(df.sparkSession)
    path = work_dir(df.sparkSession, "vectors")
    df.write.parquet(path)
    fields = [T.StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in df.schema]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def is_sparse(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType)


def arrays(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(slots, vals) of a sparse struct or of a dense array, whose slots are null."""
    c = F.col(column)
    if is_sparse(df.schema[column].dataType):
        return c["indices"].alias("slots"), c["values"].alias("vals")
    return F.lit(None).cast("array<int>").alias("slots"), c.cast("array<double>").alias("vals")


def width(df: DataFrame, column: str) -> int:
    c = F.col(column)
    return df.select(c["size"] if is_sparse(df.schema[column].dataType) else F.size(c)).first()[0]


def between(kind: T.DataType, a: str, b: str, step: Column) -> Column:
    """``a + step * (b - a)`` of two vector columns of type ``kind``; sparse ones on the union of their slots."""
    if not is_sparse(kind):
        return F.zip_with(a, b, lambda x, y: x + step * (y - x))
    a, b = F.col(a), F.col(b)

    def at(v: Column, slot: Column) -> Column:
        return F.coalesce(F.get(v["values"], (F.array_position(v["indices"], slot) - 1).cast("int")), F.lit(0.0))

    slots = F.array_sort(F.array_union(a["indices"], b["indices"]))
    return F.struct(a["type"].alias("type"), a["size"].alias("size"), slots.alias("indices"),
                    F.transform(slots, lambda i: at(a, i) + step * (at(b, i) - at(a, i))).alias("values"))


# --- inside tasks ---------------------------------------------------------------------------------------

def occupied(slots: Sequence) -> np.ndarray | None:
    """The sorted slots that occur in any of the rows; None for dense rows."""
    if not len(slots) or slots[0] is None:
        return None
    return np.unique(np.concatenate([np.asarray(s, dtype=np.int64) for s in slots]))


def block(slots: Sequence, vals: Sequence, seen: np.ndarray | None) -> np.ndarray:
    """Rows as a matrix over the slots ``seen``, or as they are where they are dense."""
    if seen is None:
        return np.array([np.asarray(v, dtype=np.float64) for v in vals])
    out = np.zeros((len(vals), len(seen)))
    sizes = [len(v) for v in vals]
    at = np.searchsorted(seen, np.concatenate([np.asarray(s, dtype=np.int64) for s in slots]))
    out[np.repeat(np.arange(len(sizes)), sizes), at] = np.concatenate([np.asarray(v, dtype=np.float64) for v in vals])
    return out
