"""Quality counts gathered while a table passes by: no job of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.quality import missing_count


def observed(df: DataFrame, label: str = "label", leave_out: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df``, counted as it is read: rows, missing values of each column but ``leave_out``, rows labelled 1. The counts are there after
    the first action."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[missing_count(df, c).alias(f"missing:{c}") for c in df.columns if c not in leave_out]]
    if label in df.columns:
        counts.append(F.count_if(F.col(label) == 1).alias("labelled"))
    return df.observe(seen, *counts), seen


def counts(spark: SparkSession, seen: Observation) -> DataFrame:
    """(metric, value): rows, labelled, and missing:<column> where there is any; waits for the action."""
    found = [(k, int(v)) for k, v in sorted(seen.get.items()) if v or not k.startswith("missing:")]
    return spark.createDataFrame(found, "metric string, value long")
