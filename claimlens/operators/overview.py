"""Dataset overview: demographics, cost by age band, class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.prefix import exact_medians


def age_band(c="usia"):
    return (F.floor(F.col(c) / 10) * 10).cast("int")


def demographics(features: DataFrame) -> DataFrame:
    return (features.groupBy("jenkel", "kelasrawat")
            .agg(F.count(F.lit(1)).alias("claims"),
                 F.sum("label").cast("bigint").alias("frauds"),
                 F.avg("biaya").alias("avg_cost"),
                 F.avg("lama_rawat").alias("avg_stay")))


def cost_by_age(features: DataFrame) -> DataFrame:
    """Claims and cost per 10-year age band, with the exact median cost."""
    banded = features.select(age_band().alias("age_band"), "biaya")
    agg = (banded.groupBy("age_band")
           .agg(F.count(F.lit(1)).alias("claims"),
                F.sum("biaya").alias("total_cost"),
                F.min("biaya").alias("min_cost"),
                F.max("biaya").alias("max_cost"),
                F.avg("biaya").alias("avg_cost")))
    # claims of unknown age form a band of their own; its name stands in for the null
    named = F.coalesce(F.col("age_band").cast("string"), F.lit("unknown"))
    med = exact_medians(banded.select(named.alias("name"), F.col("biaya").alias("x")), persist=False)
    med = med.select(F.col("name").alias("_band"), F.col("median").alias("median_cost"))
    return agg.join(med, named == F.col("_band"), "left").drop("_band")


def imbalance(features: DataFrame) -> DataFrame:
    return (features.groupBy("typefaskes")
            .agg(F.count(F.lit(1)).alias("claims"),
                 F.sum("label").cast("bigint").alias("frauds"),
                 (F.sum("label") / F.count(F.lit(1))).alias("fraud_rate")))
