"""CSV rows set aside, the run store, counts observed in passing, text claims sent twice."""

from pyspark.sql import functions as F

from claimlens.operators import observed as OB
from claimlens.operators import quality as QA
from claimlens.sources import bulk as BU
from claimlens.sources import runs as RU

SCHEMA = "id long, cost double, code string"


def test_csv_rows_and_reasons(spark, tmp_path):
    lines = ["id,cost,code", "1,2.5,A", "x2,2.5,B", "3,n/a,C", ",4.0,D", "5,,E", '6,7.0,"F, G"', "7,8.0", "8,9.0,H,extra", ",bad,I"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = BU.read_claims(spark, str(tmp_path / "in.csv"), schema)
    bad = {r["_corrupt_record"]: (r.reason, r.code) for r in BU.rejects(rows).collect()}
    assert bad == {"x2,2.5,B": ("unparsable", "B"), "3,n/a,C": ("unparsable", "C"), None: ("no id", "D"), "7,8.0": ("unparsable", None),
                   "8,9.0,H,extra": ("unparsable", "H"), ",bad,I": ("unparsable", "I")}
    assert {(r.id, r.cost, r.code) for r in BU.usable(rows).collect()} == {(1, 2.5, "A"), (5, None, "E"), (6, 7.0, "F, G")}
    assert {r.reason: r["count"] for r in rows.groupBy("reason").count().collect()} == {None: 3, "unparsable": 5, "no id": 1}  # also when no other column is asked for
    for _ in range(2):  # a repeated batch replaces itself
        report, rejects = BU.scored_report(spark, str(tmp_path / "in.csv"), schema, str(tmp_path / "out"), "b1", lambda c: c.select("id", F.lit(1).alias("s")))
    BU.scored_report(spark, str(tmp_path / "in.csv"), schema, str(tmp_path / "out"), "b2", lambda c: c.select("id", F.lit(2).alias("s")))
    assert spark.read.parquet(report).groupBy("batch").count().orderBy("batch").collect() == [("b1", 3), ("b2", 3)]
    assert spark.read.parquet(rejects).count() == 12


def test_run_store(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run, n in (("2024-01-01 10:00", 2), ("2024-03-01 09:00", 5), ("2024-02-01 08:00", 3), ("2024-03-01 09:00", 4)):
        RU.append(spark.range(n), path, run)
    assert RU.latest(spark, path).count() == 4 and RU.latest(spark, path).columns == ["id"]
    assert {r.run: r["count"] for r in RU.runs(spark, path).groupBy("run").count().collect()} == {"2024-01-01 10:00": 2, "2024-02-01 08:00": 3, "2024-03-01 09:00": 4}
    figures = spark.createDataFrame([("val", 1, 0.5, 0.25)], "set string, iteration int, loss double, recall double")
    assert {tuple(r) for r in RU.figure_rows(figures).collect()} == {("val", 1, "loss", 0.5), ("val", 1, "recall", 0.25)}


def test_observed_counts_equal_the_report(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 1), (3, None, 0)], "id long, x double, label int").repartition(2)
    passed, seen = OB.observed(df)
    assert passed.where("id > 0").count() == 3
    got = {r.metric: r.value for r in OB.counts(spark, seen).collect()}
    assert got == {"rows": 3, "labelled": 1, "missing:x": 2, "missing:label": 1}
    assert {f"missing:{r.column}": r.missing for r in QA.missing_values(df).collect()} == {k: v for k, v in got.items() if ":" in k}
