"""Text normalisation of claim code columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K


# whitespace stripped from both ends (space, tab, newline, vertical tab, form feed, return)
WHITESPACE = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    """Strip surrounding whitespace (not only blanks, unlike ``trim``)."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def strip_upper(c: Column | str) -> Column:
    """Strip surrounding whitespace and upper-case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(strip(c))


def clean_text(c: Column | str) -> Column:
    """Normalised text; a missing value becomes the token ``NAN``."""
    return F.coalesce(strip_upper(c), F.lit(K.MISSING_TEXT))


def clean_text_columns(df: DataFrame, columns=K.TEXT_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_text(c) for c in present})


def null_tokens(c: Column | str) -> Column:
    """Scoring-time rule: strip, and map the missing tokens (or null) to ``NAN``."""
    c = F.col(c) if isinstance(c, str) else c
    s = strip(c)
    return F.when(s.isNull() | s.isin(*K.SCORING_MISSING_TOKENS), F.lit(K.MISSING_TEXT)).otherwise(s)


def null_token_columns(df: DataFrame, columns=K.SCORING_TOKEN_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: null_tokens(c) for c in present})
