"""Child tables of a claim: diagnoses and procedures.

Every step is an aggregation keyed by claim id with map-side partial
aggregation, so a claim id that holds a large share of the child rows is
spread over tasks by its (id, code) pairs before the final per-id count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORD = "ord"


def normalise_diag_columns(diag: DataFrame) -> DataFrame:
    """Accept either ``diag`` or ``kddiag`` as the code column."""
    if "kddiag" in diag.columns and "diag" not in diag.columns:
        diag = diag.withColumnRenamed("kddiag", "diag")
    return diag


def dedupe_rows(df: DataFrame, order_col: str = ORD) -> DataFrame:
    """Full-row distinct over every column except ``order_col``; keeps the first
    occurrence (smallest order value). Nulls compare equal, as in a row dedupe."""
    keys = [c for c in df.columns if c != order_col]
    if order_col not in df.columns:
        return df.dropDuplicates(keys)
    return df.groupBy(*keys).agg(F.min(order_col).alias(order_col))


def primary_diagnosis(diag_dedup: DataFrame) -> DataFrame:
    """Last (by order) level-1 diagnosis per claim, among de-duplicated rows."""
    return (diag_dedup.where(F.col("levelid") == 1)
            .groupBy("id").agg(F.max_by("diag", ORD).alias("diag")))


def secondary_counts(diag_dedup: DataFrame) -> DataFrame:
    """Number of distinct level-2 rows per claim."""
    return (diag_dedup.where(F.col("levelid") == 2)
            .groupBy("id").agg(F.count(F.lit(1)).alias("diagfkrtl_sekunder_counts")))


def diag_prepared(diag: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Primary diagnosis per claim with its secondary count (0 when none); ``by``: the columns that name a claim.

    One de-duplication and one per-claim aggregate: the latest level-1 code
    (``max_by`` ignores rows whose order key is null, i.e. other levels) and
    the number of level-2 rows. Claims with secondary rows but no primary do
    not appear, as with a left join from the primaries."""
    d = dedupe_rows(normalise_diag_columns(diag))
    lvl = F.col("levelid")
    per_claim = d.groupBy(*by).agg(
        F.count_if(lvl == 1).alias("_n_primary"),
        F.max_by("diag", F.when(lvl == 1, F.col(ORD))).alias("diag"),
        F.count_if(lvl == 2).cast("bigint").alias("diagfkrtl_sekunder_counts"))
    return per_claim.where(F.col("_n_primary") > 0).drop("_n_primary")


def proc_counts(proc: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Distinct procedure rows per claim."""
    return (proc.dropDuplicates().groupBy(*by)
            .agg(F.count(F.lit(1)).alias("proc_count")))
