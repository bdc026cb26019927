"""Seeded, exact-size sampling and splits, ordered by an md5 hash of the key.

Rows are counted by hash bucket (``prefix.hash_cuts``) and only the buckets that
hold a cut are ranked, so most rows are kept or dropped without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.operators.prefix import hash_cuts, md5_key


def sample_size(frac: float, n: int) -> int:
    """Rows drawn for a fraction: half-even rounding of frac * n."""
    return int(round(frac * n))


def sample_exact(df: DataFrame, frac: float = K.SAMPLE_FRACTION, seed: int = K.SEED,
                 key: str = "id") -> DataFrame:
    """Exactly round(frac * N) rows, the smallest md5(key:seed); all rows if frac >= 1."""
    if frac >= 1.0:
        return df
    return eval_subsample(df, sample_size(frac, df.count()), seed, key)


def sample_children(child: DataFrame, sample: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose claim is in the sample (left semi join)."""
    return child.join(sample.select(key), key, "left_semi")


def stratified_split(df: DataFrame, label: str = "label", seed: int = K.SEED,
                     test_size: float = K.TEST_SIZE, val_size: float = K.VAL_SIZE,
                     key: str = "id") -> DataFrame:
    """Adds ``split`` in {train, val, test}, stratified by ``label``.

    Per stratum of n rows in md5(key:seed) order: the first ceil(test*n) rows
    are test, the next ceil(val*(n - test rows)) are validation, the rest train.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per label value
    cuts = {}
    for value, n in sizes.items():
        test = math.ceil(n * test_size)
        cuts[value] = [test, test + math.ceil((n - test) * val_size)]
    parts = hash_cuts(df, md5_key(key, seed=seed), cuts, label)
    name = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "val").otherwise("train")
    return parts.withColumn("split", name).drop("_part")


def eval_subsample(df: DataFrame, n: int, seed: int = K.SEED, key: str = "id") -> DataFrame:
    """At most n rows, the smallest md5(key:seed)."""
    return hash_cuts(df, md5_key(key, seed=seed), {None: [n]}).where(F.col("_part") == 0).drop("_part")


def undersample(df: DataFrame, label: str = "label", ratio: float = K.UNDERSAMPLE_RATIO,
                seed: int = K.SEED, key: str = "id") -> DataFrame:
    """Keep every minority row and int(minority / ratio) majority rows; labels must take two values."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(3).collect()}
    if len(counts) != 2:
        raise ValueError(f"under-sampling needs two label values, found {len(counts)}")
    minority = min(counts, key=lambda k: (counts[k], k))
    majority = max(counts, key=lambda k: (counts[k], k))
    cuts = {minority: [counts[minority]], majority: [int(counts[minority] / ratio)]}
    return hash_cuts(df, md5_key(key, seed=seed), cuts, label).where(F.col("_part") == 0).drop("_part")


def sampled_tables(claims: DataFrame, diag: DataFrame, proc: DataFrame,
                   frac: float = K.SAMPLE_FRACTION, seed: int = K.SEED, key: str = "id"):
    """Exact-size claim sample with only its child rows (semi joins); all rows when frac >= 1."""
    if frac >= 1.0:
        return claims, diag, proc
    s = sample_exact(claims, frac, seed, key)
    return s, sample_children(diag, s, key), sample_children(proc, s, key)
