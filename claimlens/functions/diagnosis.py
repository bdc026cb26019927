"""ICD-10 diagnosis code cleaning and chapter mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.functions.text import strip_upper


# a valid code: empty; or a non-digit then at most one character; or a
# non-digit followed by two digits and anything after
VALID_CODE = r"(?s)^(|[^0-9].?|[^0-9][0-9]{2}.*)$"


def clean_diag(c: Column | str) -> Column:
    """Normalised three-character diagnosis code.

    The text form of a missing value (``NAN``) is treated like any other text.
    Whole-value typo fixes come first (their results are valid codes); then a
    leading digit, or (three or more characters) a second/third character pair
    that is not two digits, marks the code invalid (``Z09.8``). The result
    keeps the first three characters.

    Written as one CASE whose first condition already evaluates the cleaned
    text, so code generation computes it once per row.
    """
    s = F.coalesce(strip_upper(c), F.lit(K.MISSING_TEXT))
    fixes = list(K.DIAG_WHOLE_VALUE_FIXES.items())
    out = F.when(s == fixes[0][0], F.lit(fixes[0][1][:K.DIAG_LEN]))
    for bad, good in fixes[1:]:
        out = out.when(s == bad, F.lit(good[:K.DIAG_LEN]))
    return (out.when(s.rlike(VALID_CODE), F.substring(s, 1, K.DIAG_LEN))
            .otherwise(F.lit(K.DIAG_INVALID[:K.DIAG_LEN])))


def code_letter(c: Column) -> Column:
    return F.substring(c, 1, 1)


def code_number(c: Column) -> Column:
    """Number after the letter; text that is not a whole number gives null."""
    return F.substring(c, 2, 1 << 30).try_cast("int")


def icd_chapter(letter: Column, number: Column) -> Column:
    """ICD-10 chapter of (letter, number); rules applied in order, later wins."""
    out = F.lit(K.ICD10_DEFAULT)
    for chapter, letters, lo, hi in K.ICD10_RULES:
        cond = letter.isin(*letters)
        if lo is not None:
            cond = cond & (number >= lo)
        if hi is not None:
            cond = cond & (number <= hi)
        out = F.when(cond, F.lit(chapter)).otherwise(out)
    return out
