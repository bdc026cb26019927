"""Fitted state that merges: each batch of claims leaves value counts and quantile sketches, and a later fit adds them up without reading old claims.

A batch brings its claims with their own diagnoses. Modes and the facility vocabulary of the merged counts equal those of a fit on all claims at
once; medians come from merged sketches, off by at most ``RANK_ERROR`` of the rows in rank. A batch appended again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.operators.impute import collect_params
from claimlens.operators.prefix import modes_from_counts, stack, value_counts
from claimlens.plans import features as FE
from claimlens.sources import runs as RU

SKETCH_K = 4096
RANK_ERROR = 0.0025  # about twice the sketch's own bound at this size
VOCABULARY = K.OPEN_CAT_COLUMNS[0]


def _measured(claims: DataFrame, diag: DataFrame) -> tuple[DataFrame, DataFrame]:
    main = FE.clean_main(claims)
    return main, FE.joined_diag(main.select("id"), diag)


def batch_counts(claims: DataFrame, diag: DataFrame) -> DataFrame:
    """(name, v, n): occurrences of each value of the columns with modes or a vocabulary."""
    main, joined = _measured(claims, diag)
    columns = [c for c in K.MODE_COLUMNS if c in main.columns] + list(K.OPEN_CAT_COLUMNS)
    return value_counts(stack(main, columns, cast="string").unionByName(stack(joined, ["diagfkrtl_letter"], cast="string")))


def median_values(claims: DataFrame, diag: DataFrame) -> DataFrame:
    """(name, x) of the columns with medians, without nulls and NaN."""
    main, joined = _measured(claims, diag)
    long = stack(main, K.MEDIAN_COLUMNS, cast="double", value="x").unionByName(
        stack(joined, ["diagfkrtl_num", "diagfkrtl_sekunder_counts"], cast="double", value="x"))
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def append(claims: DataFrame, diag: DataFrame, path: str, batch: str) -> None:
    """Writes the batch's counts and sketches below ``path``."""
    RU.append(batch_counts(claims, diag), f"{path}/counts", batch)
    sketches = median_values(claims, diag).groupBy("name").agg(F.kll_sketch_agg_double("x", SKETCH_K).alias("sketch"))
    RU.append(sketches, f"{path}/sketches", batch)


def merged_counts(spark: SparkSession, path: str) -> DataFrame:
    return RU.runs(spark, f"{path}/counts").groupBy("name", "v").agg(F.sum("n").alias("n"))


def merged_modes(spark: SparkSession, path: str) -> DataFrame:
    """(name, mode) over all batches."""
    return modes_from_counts(merged_counts(spark, path).where(F.col("name") != VOCABULARY))


def merged_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the facility types of all batches; their counts are read, no claim."""
    return RU.runs(spark, f"{path}/counts").where(F.col("name") == VOCABULARY).select(F.col("v").alias("value")).distinct()


def merged_medians(spark: SparkSession, path: str) -> DataFrame:
    """(name, median) over all batches; a value of the column."""
    sketch = RU.runs(spark, f"{path}/sketches").groupBy("name").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return sketch.select("name", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"))


def merged_params(spark: SparkSession, path: str) -> FE.FeatureParams:
    """The fitted state of all batches, as ``features.fit`` would return it."""
    m, med = collect_params(merged_modes(spark, path), "mode"), collect_params(merged_medians(spark, path), "median")
    return FE.FeatureParams(
        modes={c: m.get(c) for c in K.MODE_COLUMNS}, medians={c: med.get(c) for c in K.MEDIAN_COLUMNS},
        diag_letter_mode=m.get("diagfkrtl_letter"), diag_num_median=med.get("diagfkrtl_num"),
        secondary_median=med.get("diagfkrtl_sekunder_counts"), facility_vocab=sorted(r[0] for r in merged_vocabulary(spark, path).collect()))


def rank_checked(values: DataFrame, medians: DataFrame) -> DataFrame:
    """(name, within): whether each median's rank among ``values`` (name, x) is within ``RANK_ERROR`` of one half."""
    n, below = F.count(F.lit(1)), F.count_if(F.col("x") < F.col("median"))
    upto = F.count_if(F.col("x") <= F.col("median"))
    within = (below / n <= 0.5 + RANK_ERROR) & (upto / n >= 0.5 - RANK_ERROR)
    return values.join(F.broadcast(medians), "name").groupBy("name").agg(within.alias("within"))  # a row for each column with a median
