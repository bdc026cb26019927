"""Registered queries against their DuckDB oracle SQL on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from claimlens.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["clean_text", "cbg_split", "kds_split", "stay_days", "clean_diag", "icd_chapter", "diag_prepared",
        "proc_count", "fit_modes", "fit_medians", "features", "validate", "missing", "sample_exact", "split",
        "metrics_by_split", "roc_auc", "pr_auc", "pr_curve", "onehot_open", "ordinal", "score_batch", "reasons"]


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool)) else str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)


def test_every_query_runs(spark):
    qs = E.queries()
    assert len(qs) >= 40
    for k in ["features", "score_batch", "roc_auc"]:
        assert k in E.oracle_sql()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_column_types_match_oracle(spark, con, name):
    s = dict(E.queries()[name](spark, SF_SMALL).dtypes)
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in s.items()} == d
