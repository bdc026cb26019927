"""Data quality report: counts, missing values, duplicate rows, types, label shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.prefix import stack


def missing_count(df: DataFrame, c: str) -> Column:
    """Rows without a value in column ``c`` (NaN counts)."""
    col = F.col(f"`{c}`")
    dt = df.schema[c].dataType
    cond = col.isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        cond = cond | F.isnan(col)
    return F.count_if(cond)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) for columns with at least one missing value (NaN counts)."""
    counts = df.agg(*[missing_count(df, c).alias(c) for c in df.columns])
    return stack(counts, df.columns, cast="bigint", name="column", value="missing").where(F.col("missing") > 0)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows that repeat an earlier row exactly."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_records"))


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    """Column types, from the schema (no data is read)."""
    return list(df.dtypes)


def validate(df: DataFrame, name: str) -> DataFrame:
    """One-row report: table name, rows, columns, duplicate rows (one aggregation)."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("num_rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_records")) \
        .select(F.lit(name).alias("table_name"), "num_rows",
                F.lit(len(df.columns)).cast("int").alias("num_cols"), "duplicate_records")


def label_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of each non-null label value."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # counts has one row per label value: a global window over it is tiny
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.col(label).alias("label"), F.col("n").alias("count"),
                         (F.col("n") / total).alias("share"))


def quality_report(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, duplicate rows, missing values per column (only
    those with any) and column types, from a single grouped pass: the distinct
    rows carry their multiplicity, so every count is a sum over them."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))

    def miss(c):
        cond = F.col(f"`{c}`").isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(F.col(f"`{c}`"))
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).cast("bigint")

    out = g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("num_rows"),
                F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_records"),
                F.array(*[miss(c) for c in df.columns]).alias("_miss"))
    names = F.array(*[F.lit(c) for c in df.columns])
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return out.select(
        F.lit(name).alias("table_name"), "num_rows", F.lit(len(df.columns)).cast("int").alias("num_cols"),
        "duplicate_records",
        F.map_filter(F.map_from_arrays(names, F.col("_miss")), lambda k, v: v > 0).alias("missing_values"),
        types.alias("dtypes"))
