"""Run store: tables partitioned by run. Appending a run writes its folder whole, so a repeated append replaces itself and other runs stay."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = "run"


def folder(path: str, column: str, value: str) -> str:
    """The folder of one partition, its value escaped as Spark's readers expect it."""
    return f"{path}/{column}={quote(value, safe='')}"


def append(df: DataFrame, path: str, run: str) -> None:
    """Rows of one run; ``run`` sorts by time (a date and time, say)."""
    df.write.mode("overwrite").parquet(folder(path, RUN, run))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, with the column ``run`` as text; a filter on it reads that run's files alone."""
    found = spark.read.option("basePath", path).parquet(path).schema
    kinds = T.StructType([T.StructField(RUN, T.StringType()) if f.name == RUN else f for f in found.fields])
    return spark.read.schema(kinds).option("basePath", path).parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest run, without ``run``."""
    table = runs(spark, path)
    newest = table.select(F.max(RUN)).first()[0]  # reads no column of the rows
    return table.where(F.col(RUN) == F.lit(newest)).drop(RUN)


def figure_rows(figures: DataFrame) -> DataFrame:
    """(set, iteration, metric, value) of per-round figures."""
    names = [c for c in figures.columns if c not in ("set", "iteration")]
    return figures.unpivot(["set", "iteration"], names, "metric", "value")
