"""Micro-goldens for the column functions (hand-derived expected values)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.functions.codes import kdsa_severity, split_code
from claimlens.functions.dates import stay_days
from claimlens.functions.diagnosis import clean_diag, code_letter, code_number, icd_chapter
from claimlens.functions.scoring import confidence, decide, reason_codes
from claimlens.functions.text import clean_text, null_tokens


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("code,parts", [
    ("E-4-10-I", ["E", "4", "10", "I"]),
    ("A-1-I", ["A", "-", "1", "I"]),
    ("-", ["-", "-", "-", "-"]),
    ("NAN", ["-", "-", "-", "-"]),
    ("A-B-C-D-E", ["-", "-", "-", "-"]),
    ("E--10-I", ["E", "", "10", "I"]),
    (None, ["-", "-", "-", "-"]),
])
def test_split_code(spark, code, parts):
    df = spark.createDataFrame([(code,)], "c string")
    p = split_code("c")
    row = df.select(*[p[k] for k in ["CMG", "tipekasus", "spesifikkasus", "severity"]]).first()
    assert list(row) == parts


def test_kdsa_severity(spark):
    got = one_col(spark, ["0", "IV", "-", "I", "II", "III", ""], kdsa_severity)
    assert got == ["III", "III", "-", "I", "II", "III", "III"]


def test_clean_diag(spark):
    vals = ["h8.14", "XH8.14", "ZO3.9", "123", "5", "A1", "-", "", None, " e11.9 ", "K29.7"]
    assert one_col(spark, vals, clean_diag) == ["H81", "Z09", "Z03", "Z09", "Z09", "A1", "-", "", "Z09", "E11", "K29"]


def test_chapters(spark):
    codes = ["C80", "D48", "D49", "D50", "H59", "H60", "U07", "W19", "Z09", "-"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    num = F.coalesce(code_number(F.col("c")), F.lit(0))
    got = [r[0] for r in df.select(icd_chapter(code_letter(F.col("c")), num)).collect()]
    assert got == ["II", "II", "XXII", "III", "VII", "VIII", "XXII", "XXII", "XXI", "XXII"]


def test_code_number_non_numeric(spark):
    assert one_col(spark, ["A.", "A", "AB", "A12"], code_number) == [None, None, None, 12]


def test_clean_text_and_tokens(spark):
    assert one_col(spark, [" l", "P ", None, "\tb\n"], clean_text) == ["L", "P", "NAN", "B"]
    assert one_col(spark, ["-", "nan", "None", "NAN", "", " x ", None, "A-1"], null_tokens) == \
        ["NAN", "NAN", "NAN", "NAN", "NAN", "x", "NAN", "A-1"]


def test_stay_days_floor(spark):
    rows = [(dt.datetime(2022, 6, 10, 18), dt.datetime(2022, 6, 12, 6)),
            (dt.datetime(2022, 6, 10, 0), dt.datetime(2022, 6, 9, 12)),
            (dt.datetime(2022, 6, 10), None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(stay_days("a", "b")).collect()] == [1, -1, None]


def test_confidence_and_decision(spark):
    t = 0.7868109
    df = spark.createDataFrame([(0.0,), (0.5,), (t,), (1.0,)], "p double")
    rows = df.select(confidence(F.col("p"), t), decide(F.col("p"), t)).collect()
    assert [round(r[0], 6) for r in rows] == [1.0, 0.682262, 0.5, 0.999998]
    assert [r[1] for r in rows] == [0, 0, 1, 1]


def test_reasons(spark):
    df = spark.createDataFrame([(2e7, 11, 5, 6), (1e7, 10, 4, 5)], "c double, s int, d int, p int")
    got = [r[0] for r in df.select(reason_codes(F.col("c"), F.col("s"), F.col("d"), F.col("p"))).collect()]
    assert got[0] == ["high_cost", "long_stay", "many_secondary_diagnoses", "many_procedures"]
    assert got[1] == []
