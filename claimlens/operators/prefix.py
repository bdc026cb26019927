"""Global running sums without a single-task window.

A window with ``orderBy`` and no ``partitionBy`` moves every row to one task.
Here the order key is first mapped to a bucket that is monotone in the key
(a hash prefix, or approximate-quantile splits applied by binary search), the
running sum is taken per bucket, and each bucket adds the total of the
buckets before it. The offsets table has one row per (group, bucket) - its
size is bounded by the bucket count times the number of strata, so it is
safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import kept

BUCKET = "_bkt"
HASH_PREFIX_HEX = 4  # 16**4 = 65,536 uniform buckets for md5-ordered keys (window parallelism)
MAX_QUANTILE_BUCKETS = 4096


def md5_key(*cols: Column | str, seed: int | None = None) -> Column:
    """Shared ordering hash: md5 of the values joined by ':' (seed last)."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(h: Column | str) -> Column:
    """Bucket of an md5 hex string; monotone in the string, uniform in size."""
    h = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(h, 1, HASH_PREFIX_HEX), 16, 10).cast("int")


def with_quantile_bucket(df: DataFrame, col: str, buckets: int | None = None,
                         relative_error: float = 0.001) -> DataFrame:
    """Add ``_bkt`` from approximate quantile splits of a numeric column.

    Splits come from one distributed sketch pass; the number of splits is
    bounded, and ``Bucketizer`` places each row by binary search (JVM-side).
    Equal keys always land in the same bucket.
    """
    if buckets is None:
        parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
        buckets = max(2, min(MAX_QUANTILE_BUCKETS, 4 * int(parts)))
    tmp = "_qb_in"
    d = df.withColumn(tmp, F.col(col).cast("double"))
    qd = QuantileDiscretizer(numBuckets=buckets, inputCol=tmp, outputCol=BUCKET,
                             relativeError=relative_error, handleInvalid="keep")
    model = qd.fit(d)
    return model.transform(d).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop(tmp)


def running_sums(df: DataFrame, order: Sequence[Column | str], measures: Sequence[str],
                 bucket: Column | str = BUCKET, groups: Sequence[str] = (),
                 prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``measures`` in ``order`` (restarting per ``groups``).

    ``bucket`` must be non-decreasing in ``order``. Rows with equal order keys
    get distinct running values (row frame); aggregate ties first when they
    must share one value.
    """
    groups = list(groups)
    d = df.withColumn(BUCKET, F.col(bucket) if isinstance(bucket, str) else bucket) \
        if not (isinstance(bucket, str) and bucket == BUCKET) else df
    keys = groups + [BUCKET]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.withColumns({f"_loc_{m}": F.sum(m).over(w) for m in measures})
    # totals from a separate partial aggregate: that branch reads only the key
    # columns (pruned scan) and shuffles one row per bucket and task
    totals = d.groupBy(*keys).agg(*[F.sum(m).alias(f"_tot_{m}") for m in measures])
    wo = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"_tot_{m}").over(wo), F.lit(0)).alias(f"_off_{m}")
                                     for m in measures])
    # null-safe keys: a null group is a group like any other
    off = offsets.withColumnsRenamed({k: f"_off_key_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_off_key_{k}")) for k in keys])
    out = local.join(off, same, "inner").drop(*[f"_off_key_{k}" for k in keys])
    out = out.withColumns({f"{prefix}{m}": F.col(f"_loc_{m}") + F.col(f"_off_{m}") for m in measures})
    return out.drop(BUCKET, *[f"_loc_{m}" for m in measures], *[f"_off_{m}" for m in measures])


def hash_rank(df: DataFrame, key: Column, groups: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row in md5-key order; rows with equal keys are ordered by a hash of all their plain columns."""
    d = df.withColumn("_h", key).withColumn("_tie", tie_break(df)).withColumn("_one", F.lit(1).cast("long"))
    out = running_sums(d, ["_h", "_tie"], ["_one"], bucket=hash_bucket("_h"), groups=groups, prefix="_cum")
    return out.withColumnRenamed("_cum_one", rank_col).drop("_one", "_h", "_tie")


def tie_break(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType, T.NumericType))]
    return F.xxhash64(*[F.col(c).cast("string") for c in plain]) if plain else F.lit(0).cast("long")


def hash_cuts(df: DataFrame, key: Column, cuts: dict, label: str | None = None) -> DataFrame:
    """``df`` with ``_part``: how many of its label's ``cuts`` (ascending row counts in md5-key order) a row lies beyond.

    Rows are counted by hash bucket (at most 65,536 counts for each label come back); whole buckets then fall on one
    side of a cut without a shuffle, and only the rows of the buckets that hold a cut are ranked. ``cuts`` maps
    label values (None for a null label, or when there is no label) to lists of counts.
    """
    d = df.withColumn("_h", key).withColumn("_b", hash_bucket("_h"))
    lab = F.col(label) if label else F.lit(None).cast("string")
    sizes: dict = {}
    for r in d.groupBy(lab.alias("_l"), "_b").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r["_l"], {})[r["_b"]] = r["n"]
    part, within = F.lit(0), []
    for value, limits in cuts.items():
        mine = lab.eqNullSafe(F.lit(value)) if label else F.lit(True)
        places, total, at = [], 0, 0
        ordered = sorted(sizes.get(value, {}).items())
        for limit in limits:
            while at < len(ordered) and total + ordered[at][1] <= limit:
                total += ordered[at][1]
                at += 1
            places.append((ordered[at][0] if at < len(ordered) else 1 << 30, limit - total))
        count = reduce(add, [(F.col("_b") >= b).cast("int") for b, _ in places])
        part = F.when(mine, count).otherwise(part)
        within += [(mine, b, need) for b, need in places if need > 0]
    d = d.withColumn("_part", part)
    if not within:
        return d.drop("_h", "_b")
    cut = reduce(or_, [m & (F.col("_b") == b) for m, b, _ in within])
    w = Window.partitionBy(lab, "_b").orderBy("_h", tie_break(df))
    ranked = d.where(cut).withColumn("_r", F.row_number().over(w))
    taken = reduce(add, [F.when(m & (F.col("_b") == b) & (F.col("_r") <= need), 1).otherwise(0) for m, b, need in within])
    ranked = ranked.withColumn("_part", F.col("_part") - taken).drop("_r")
    return d.where(~F.coalesce(cut, F.lit(False))).unionByName(ranked).drop("_h", "_b")


def exact_medians(long: DataFrame, name: str = "name", value: str = "x",
                  persist: bool = True) -> DataFrame:
    """Exact median per ``name`` (middle two averaged), nulls and NaN ignored.

    Input is long form (name, value). Values are first counted per distinct
    value (map-side partial aggregation), then ranked by bucketed running sums;
    no task ever holds a whole column.
    """
    v = F.col(value).cast("double")
    vc = (long.select(F.col(name).alias("name"), v.alias("x"))
          .where(F.col("x").isNotNull() & ~F.isnan("x"))
          .groupBy("name", "x").agg(F.count(F.lit(1)).alias("n")))
    if persist:
        # read twice (quantile sketch, then ranking): keep the distinct-value
        # counts instead of recomputing the upstream plan
        vc = kept(vc)
    vc = with_quantile_bucket(vc, "x")
    rs = running_sums(vc, ["x"], ["n"], groups=["name"])
    tot = vc.groupBy("name").agg(F.sum("n").alias("n_total"))
    a = F.floor((F.col("n_total") + 1) / 2)
    b = F.floor(F.col("n_total") / 2) + 1
    prev = F.col("cum_n") - F.col("n")
    hit = ((prev < a) & (a <= F.col("cum_n"))) | ((prev < b) & (b <= F.col("cum_n")))
    return (rs.join(tot, "name").where(hit)
            .groupBy("name").agg(((F.min("x") + F.max("x")) / 2).alias("median")))


def value_counts(long: DataFrame, name: str = "name", value: str = "v") -> DataFrame:
    """(name, v, n): occurrences of each non-null value per column (partial aggregation)."""
    return (long.select(F.col(name).alias("name"), F.col(value).alias("v"))
            .where(F.col("v").isNotNull())
            .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")))


def modes_from_counts(vc: DataFrame) -> DataFrame:
    """Most frequent value per name; ties go to the smallest value."""
    return vc.groupBy("name").agg(F.min_by("v", F.struct((-F.col("n")).alias("k"), F.col("v").alias("t"))).alias("mode"))


def modes(long: DataFrame, name: str = "name", value: str = "v") -> DataFrame:
    """Most frequent non-null value per ``name``; ties go to the smallest value."""
    return modes_from_counts(value_counts(long, name, value))


def stack(df: DataFrame, cols: Sequence[str], cast: str | None = None,
          name: str = "name", value: str = "v") -> DataFrame:
    """Long form (name, value) of ``cols`` via one ``explode`` (no union of scans)."""
    items = []
    for c in cols:
        val = F.col(c).cast(cast) if cast else F.col(c)
        items.append(F.struct(F.lit(c).alias(name), val.alias(value)))
    return df.select(F.explode(F.array(*items)).alias("_kv")).select(f"_kv.{name}", f"_kv.{value}")


def approx_medians(long: DataFrame, name: str = "name", value: str = "x", accuracy: int = 10_000) -> DataFrame:
    """Approximate median per ``name`` (one sketch pass, relative rank error 1 / accuracy)."""
    v = F.col(value).cast("double")
    return (long.select(F.col(name).alias("name"), v.alias("x"))
            .where(F.col("x").isNotNull() & ~F.isnan("x"))
            .groupBy("name").agg(F.percentile_approx("x", 0.5, accuracy).alias("median")))
