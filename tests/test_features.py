"""The structural pass on the in-line claim and on the sf0.001 fixture."""

import datetime as dt

from claimlens.plans import features as FE
from claimlens.sources import fixtures as FX
from tests.conftest import SF_SMALL

CLAIM = dict(id="claim_test_101", id_peserta="peserta_test_101", jenispulang="1", jenkel="P", pisat="1",
             diagfktp="E11.9", biaya=4500000.0, dati2="291", typefaskes="B", usia=55,
             tgldatang=dt.datetime(2022, 6, 10), tglpulang=dt.datetime(2022, 6, 14), jenispel="1",
             cbg="E-4-10-I", kelasrawat=2, kdsa="-", kdsp="-", kdsr="-", kdsi="-", kdsd="-", label=0)
SCHEMA = ("id string, id_peserta string, jenispulang string, jenkel string, pisat string, diagfktp string, "
          "biaya double, dati2 string, typefaskes string, usia int, tgldatang timestamp_ntz, "
          "tglpulang timestamp_ntz, jenispel string, cbg string, kelasrawat int, kdsa string, kdsp string, "
          "kdsr string, kdsi string, kdsd string, label int")


def test_inline_claim(spark):
    c = spark.createDataFrame([tuple(CLAIM.values())], SCHEMA)
    d = spark.createDataFrame([("claim_test_101", "E11.9", 1, 1), ("claim_test_101", "I10", 2, 2)],
                              "id string, diag string, levelid int, ord long")
    p = spark.createDataFrame([("claim_test_101", "99.04"), ("claim_test_101", "88.78")], "id string, proc string")
    f, params = FE.build(c, d, p)
    r = f.first().asDict()
    assert (r["cbg_CMG"], r["cbg_tipekasus"], r["cbg_spesifikkasus"], r["cbg_severity"]) == ("E", "4", "10", "I")
    assert all(r[k] == "-" for k in ["kdsa_CMG", "kdsa_tipekasus", "kdsa_spesifikkasus", "kdsa_severity",
                                     "kdsp_spesifikkasus", "kdsp_severity", "kdsr_spesifikkasus",
                                     "kdsr_severity", "kdsi_spesifikkasus", "kdsd_spesifikkasus", "kdsd_severity"])
    assert (r["diagfktp_icd10"], r["diagfkrtl_icd10"]) == ("IV", "IV")
    assert (r["lama_rawat"], r["diagfkrtl_sekunder_counts"], r["proc_count"]) == (4, 1, 2)
    assert params.facility_vocab == ["B"]


def test_fixture_one_row_per_claim(spark):
    c, d, p = FX.fixture_tables(spark, SF_SMALL)
    f, _ = FE.build(c, d, p)
    n = c.count()
    assert f.count() == n
    assert f.select("id").distinct().count() == n
    assert set(f.columns) == set(FE.FEATURE_COLUMNS)


def test_features_read_claims_joined_once(spark, tmp_path):
    """The joins are done once, for fitting and features alike: what is left is a projection, and nothing stays persisted.
    Repeated and null keys and claims without children are rows as before."""
    from claimlens import queries as Q
    from claimlens.sources.tables import SCHEMAS
    sf = str(tmp_path)
    orders = [(k, 1 + k % 2, "O", 10.0 * k, None, "1-URGENT") for k in range(1, 30)] + [(5, 1, "O", 7.5, None, "2-HIGH"), (77, 2, "O", None, None, None)]
    lines = [(k, p, s, n, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for k in (*range(1, 25), None) for n, (p, s) in enumerate([(k or 1, 3), (7, 4), (7, 4), (20, 5)], 1)]
    rows = {"orders": orders + [(None, 1, "O", 1.0, None, None)], "customer": [(1, "a", 1, 0.0, "AUTO"), (2, "b", 1, 0.0, None)], "lineitem": lines}
    for t, r in rows.items():
        spark.createDataFrame(r, SCHEMAS[t]).write.parquet(f"{sf}/{t}.parquet")
    Q.release(spark)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got = Q.feature_table(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Join", "Exchange", "InMemoryTableScan"))
    want, params = FE.build(*FX.fixture_tables(spark, sf))
    assert Q.feature_params(spark, sf) == params
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 32
    assert Q.split_features(spark, sf).count() == 32
    Q.release(spark)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
