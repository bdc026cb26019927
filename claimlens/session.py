"""Session helpers: a tuned local session for tests/bench, checkpoint dir lookup."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[str, DataFrame]] = []


def kept(df: DataFrame) -> DataFrame:
    """``df``, persisted until ``release_kept``."""
    _KEPT.append((df.sparkSession.sparkContext.applicationId, df.persist(StorageLevel.MEMORY_AND_DISK)))
    return df


def release_kept(spark: SparkSession) -> None:
    """Unpersists everything that ``kept`` holds in this application."""
    for app, df in _KEPT:
        if app == spark.sparkContext.applicationId:
            df.unpersist()
    _KEPT.clear()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "claimlens") -> SparkSession:
    """Local session for tests and the bench (a cluster session comes from spark-submit)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    tune_session(spark)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (a shared file system);
    only in local mode, as in tests, is a scratch folder made when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="claimlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def tune_session(spark: SparkSession) -> None:
    """Session SQL settings the claims plans rely on (runtime-settable).

    The feature projections fuse into generated methods larger than the
    JVM's JIT limit (8000 bytes); Spark's default fallback threshold is 64 KB,
    so such stages would run in the bytecode interpreter. Lowering the limit
    makes Spark split them into JIT-compilable pieces instead.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
                 max_partitions: int = 200_000) -> dict[str, str]:
    """Settings for a large cluster run, sized from the input volume.

    Shuffle partitions start at input / 256 MB (AQE then coalesces small ones
    and splits skewed ones); scans read 256 MB splits; broadcast joins are
    allowed only under a fixed size bound.
    """
    parts = max(200, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
    }
