"""Stream scoring equals batch scoring on the same claims."""

from pyspark.sql import functions as F

from claimlens.plans import scoring as SC
from claimlens.queries import feature_params
from claimlens.sources import fixtures as FX
from claimlens.streaming import score_stream as ST
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    params = feature_params(spark, SF_SMALL)
    stream = ST.scored_stream(spark, SF_SMALL, params)
    assert stream.isStreaming
    got = ST.run_to_table(spark, stream).toPandas().sort_values("id").reset_index(drop=True)
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    want = SC.score_batch(c, d, p, params).toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == len(want) == c.count()
    assert (got["id"].values == want["id"].values).all()
    assert (got["is_fraud"].values == want["is_fraud"].values).all()
    assert abs(got["fraud_probability"] - want["fraud_probability"]).max() < 1e-12
    assert got["confidence_score"].between(0.5, 1.0).all()


def test_stream_drops_resent_claims(spark, tmp_path):
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    for t in ["customer", "lineitem"]:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", src / f"{t}.parquet")
    shutil.copy(f"{SF_SMALL}/orders.parquet", src / "orders.parquet")
    shutil.copy(f"{SF_SMALL}/orders.parquet", src / "orders_resent.parquet")  # every claim sent twice
    params = feature_params(spark, SF_SMALL)
    stream = ST.scored_stream(spark, str(src), params, dedupe_watermark="3650 days")
    out = ST.run_to_table(spark, stream).toPandas()
    n = FX.claims(spark, SF_SMALL).count()
    assert len(out) == n and out["id"].is_unique


def test_children_in_streams_of_their_own(spark, tmp_path):
    """Early and late child rows count, rows past the watermark do not, claims without children come with null figures, each claim once."""
    def turn(name, rows, schema):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("at") * 86400))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return df.schema

    claims, diag, proc = "id long, at long", "id long, at long, diag string, levelid int, ord long", "id long, at long, proc string"
    closing = 400
    schemas = {}
    for i, (c, d, p) in enumerate((
        ([(1, 10), (2, 10)], [(1, 10, "A01", 1, 1), (3, 12, "B02", 1, 1)], [(1, 10, "x")]),              # a diagnosis before its claim
        ([(3, 12)], [(1, 10, "C09", 1, 7), (1, 10, "D10", 2, 8), (1, 10, "D10", 2, 9)], [(1, 10, "y"), (1, 10, "y")]),  # after its claim
        ([(-1, closing)], [(-1, closing, "Z99", 1, 1)], [(-1, closing, "z")]),
        ([(-3, closing)], [(-3, closing, "Z99", 1, 1)], [(-3, closing, "z")]),  # the claims fall due
        ([(-2, closing)], [(1, 10, "E11", 1, 99)], [(2, 10, "late")]),                                   # too late
    )):
        schemas = {"c": turn("c", c, claims), "d": turn("d", d, diag), "p": turn("p", p, proc)}
    streams = [spark.readStream.schema(schemas[n]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in "cdp"]
    rows = ST.with_streamed_children(*streams, time="at", delay="30 days")
    assert rows.isStreaming
    got = {r.id: (r.diagfkrtl_letter, r.diagfkrtl_num, r.diagfkrtl_sekunder_counts, r.proc_count) for r in ST.run_to_table(spark, rows, "late").collect()}
    assert got == {1: ("C", 9.0, 1, 2), 2: (None, None, None, None), 3: ("B", 2.0, 0, None)}


def test_stream_inputs_are_written_in_files_that_follow_the_rows(spark, monkeypatch, tmp_path):
    from claimlens import queries as Q
    from claimlens.sources import fixtures as FX
    monkeypatch.setattr(Q, "STREAM_FILE_ROWS", 100)
    monkeypatch.setattr(Q.SK, "work_dir", lambda spark, name: str(tmp_path / name))
    Q.nested_stream(spark, SF_SMALL)
    rows = spark.read.parquet(str(tmp_path / "nested-claims")).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in rows) <= 110 and sum(r["count"] for r in rows) == 1500
    Q.child_streams(spark, SF_SMALL)
    claims, diag, _ = FX.fixture_tables(spark, SF_SMALL)
    back = spark.read.parquet(str(tmp_path / "diagnoses-stream")).where("id <> -1")
    want = diag.join(claims.select("id", "tgldatang"), "id")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
