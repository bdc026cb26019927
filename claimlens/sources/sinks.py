"""Sinks and round trips: scored reports, evaluation data, run records,
fitted parameters and models. Everything lands in a shared folder under
the session's checkpoint directory unless a path is given."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from claimlens.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the (shared) checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "claimlens-out", f"{name}-{uuid.uuid4().hex[:12]}")


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_report(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)


def append_run_record(record: DataFrame, path: str) -> str:
    record.coalesce(1).write.mode("append").json(path)
    return path


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_params(spark: SparkSession, params: dict, path: str) -> str:
    """Fitted scalars as a one-row JSON table (a few hundred bytes)."""
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
