"""The reference's own test contract, on Spark: ingestion, validation report,
single-claim and batch prediction shapes and ranges."""

import datetime as dt

from claimlens.operators import quality as QA
from claimlens.operators import sampling as SA
from claimlens.plans import features as FE
from claimlens.plans import scoring as SC
from claimlens.sources import fixtures as FX
from tests.conftest import SF_SMALL

NESTED_SCHEMA = (
    "id string, id_peserta string, jenispulang string, jenkel string, pisat string, diagfktp string, "
    "biaya double, dati2 string, typefaskes string, usia int, tgldatang timestamp_ntz, tglpulang timestamp_ntz, "
    "jenispel string, cbg string, kelasrawat int, kdsa string, kdsp string, kdsr string, kdsi string, kdsd string, "
    "diagnoses array<struct<diag:string, levelid:int>>, procedures array<string>")
# a claim of our own; every feature it must give is asserted below
CLAIM = ("k-7", "member-7", "3", "L", "4", " j18.9 ", 2_750_000.0, "1171", "C", 34,
         dt.datetime(2021, 3, 2), dt.datetime(2021, 3, 9), "2", "J-4-16-II", 3, "-", "YY-02-III", "-", "-", "-",
         [("J18.9", 1), ("I10", 2), ("N39.0", 2), ("I10", 2)], ["87.44", "87.44", "99.29"])


def _params(spark):
    return FE.fit(*FX.fixture_tables(spark, SF_SMALL))


def test_sampled_ingestion(spark):
    c = FX.claims(spark, SF_SMALL)
    s = SA.sample_exact(c, 0.1, 42)
    assert s.count() == SA.sample_size(0.1, c.count()) > 0
    assert {"id", "label"} <= set(s.columns)


def test_validation_report_fields(spark):
    c = FX.claims(spark, SF_SMALL)
    v = QA.validate(c, "claims").first().asDict()
    assert set(v) == {"table_name", "num_rows", "num_cols", "duplicate_records"}
    assert v["num_rows"] == c.count() and v["num_cols"] == len(c.columns)
    assert {r["column"] for r in QA.missing_values(c).collect()} >= {"jenispulang", "biaya"}
    assert dict(QA.dtypes(c))["biaya"] == "double"


def test_single_prediction(spark):
    nested = spark.createDataFrame([CLAIM], NESTED_SCHEMA)
    out = SC.score_nested(nested, _params(spark)).first().asDict()
    assert set(out) == {"id", "is_fraud", "fraud_probability", "confidence_score", "explanation", "model_info"}
    assert out["is_fraud"] in (0, 1)
    assert 0.0 <= out["fraud_probability"] <= 1.0
    assert 0.5 <= out["confidence_score"] <= 1.0
    assert out["model_info"]["threshold"] == 0.7868109


def test_claim_features(spark):
    c, d, p = SC.flatten_nested(spark.createDataFrame([CLAIM], NESTED_SCHEMA))
    f = FE.transform(c, d, p, _params(spark)).first().asDict()
    assert (f["lama_rawat"], f["diagfkrtl_sekunder_counts"], f["proc_count"], f["biaya"]) == (7, 2, 2, 2_750_000.0)
    assert (f["cbg_severity"], f["kdsp_spesifikkasus"], f["diagfkrtl_icd10"], f["diagfktp_icd10"]) == ("II", "02", "X", "X")


def test_batch_prediction(spark):
    nested = spark.createDataFrame([CLAIM], NESTED_SCHEMA)
    c, d, p = SC.flatten_nested(nested)
    out = SC.score_batch(c, d, p, _params(spark))
    assert out.columns == ["id", "fraud_probability", "is_fraud", "confidence_score"]
    assert out.count() == 1
