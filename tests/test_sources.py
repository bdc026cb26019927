"""CSV source (PERMISSIVE), sinks and cluster settings."""

import os

from pyspark.sql import functions as F

from claimlens.session import cluster_conf
from claimlens.sources import sinks as SK


def test_csv_permissive_bad_number_becomes_null(spark, tmp_path):
    path = str(tmp_path / "claims.csv")
    with open(path, "w") as f:
        f.write("id,biaya,usia\n1,4500000.0,55\n2,not-a-number,40\n3,,x\n")
    df = spark.read.schema("id long, biaya double, usia int").option("header", True) \
        .option("mode", "PERMISSIVE").csv(path)
    rows = {r.id: (r.biaya, r.usia) for r in df.collect()}
    assert rows == {1: (4500000.0, 55), 2: (None, 40), 3: (None, None)}


def test_report_roundtrip_parquet_and_csv(spark):
    df = spark.createDataFrame([(1, 0.25, 1), (2, 0.75, 0)], "id long, fraud_probability double, is_fraud int")
    for fmt in ("parquet", "csv"):
        path = SK.write_report(df, SK.work_dir(spark, f"t-{fmt}"), fmt=fmt)
        back = SK.read_report(spark, path, df.schema, fmt=fmt)
        assert sorted(back.collect()) == sorted(df.collect())


def test_params_roundtrip(spark):
    p = {"modes": {"a": "1"}, "medians": {"biaya": 2.5}, "facility_vocab": ["A", "B"]}
    path = SK.save_params(spark, p, SK.work_dir(spark, "params"))
    assert SK.load_params(spark, path) == p
    assert "claimlens-out" in path  # under the shared checkpoint folder


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 * (1 << 40))                      # 100 TB / 256 MB = 409,600, capped
    assert c["spark.sql.shuffle.partitions"] == "200000"
    assert cluster_conf(10 * (1 << 40))["spark.sql.shuffle.partitions"] == "40960"
    small = cluster_conf(1 << 30)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert small["spark.sql.adaptive.skewJoin.enabled"] == "true"
