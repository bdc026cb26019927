"""Bulk claims from CSV: rows that cannot be used are set aside with the reason, the others end in a scored report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.runs import folder

CORRUPT = "_corrupt_record"
UNPARSABLE, NO_ID = "unparsable", "no id"


def read_claims(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with ``reason`` (null: usable). A row with a value that its column's type cannot hold, or with too many or too few values, is
    unparsable; its other values and, in ``_corrupt_record``, its text are kept. A row that parses needs an id."""
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    # values are parsed only in columns that are read, so the reason reads all of them (the hash's last bits, all masked, are 0)
    parsed = F.xxhash64(*schema.fieldNames()).bitwiseAND(F.lit(0)) == 0
    return rows.withColumn("reason", F.when(F.col(CORRUPT).isNotNull() & parsed, UNPARSABLE).when(F.col("id").isNull(), NO_ID))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason", CORRUPT)


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null")


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """One batch of a table in folders by batch; written again, it replaces itself."""
    df.write.mode("overwrite").parquet(folder(path, "batch", batch))


def scored_report(spark: SparkSession, source: str, schema: T.StructType, target: str, batch: str, score: Callable[[DataFrame], DataFrame]) -> tuple[str, str]:
    """Scores the usable rows of a CSV folder; returns the folders of the report and the rejects. Repeating a batch changes nothing."""
    rows = read_claims(spark, source, schema)
    write_batch(rejects(rows), f"{target}/rejects", batch)
    write_batch(score(usable(rows)), f"{target}/report", batch)
    return f"{target}/report", f"{target}/rejects"
