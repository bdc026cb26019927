"""Helpers shared by the operators: table reading, ASCII lower-casing, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; a value without capitals of any kind skips the character map."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, UPPER.lower()))


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo m; null for a null id."""
    return F.crc32(c.cast("string").cast("binary")) % m


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/claimlens-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, n_rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hints a broadcast only when the counted rows stay under ``limit`` bytes; else Spark shuffles both sides."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df.hint("merge")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's path in it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of whole texts stay small: at most ``rows`` rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
