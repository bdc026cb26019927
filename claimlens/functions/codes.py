"""Tariff (case-mix) code decomposition: ``CMG-type-specific-severity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens import constants as K

PART_NAMES = ["CMG", "tipekasus", "spesifikkasus", "severity"]


def split_code(c: Column | str) -> dict[str, Column]:
    """Four parts of a dash-separated code.

    Four pieces are taken as they are; three pieces have no case type (``-``);
    any other count gives ``-`` for every part. Empty pieces are kept.
    """
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.coalesce(c.cast("string"), F.lit(K.MISSING_TEXT)), "-", -1)
    return {p: _pick(parts, p) for p in PART_NAMES}


def kdsa_severity(c: Column) -> Column:
    """kdsa severities outside ``- I II III`` become ``III``."""
    return F.when(c.isin(*K.KDSA_SEVERITY_KEPT), c).otherwise(F.lit(K.KDSA_SEVERITY_OTHER))


def _pick(parts: Column, part: str) -> Column:
    n = F.size(parts)
    dash = F.lit("-")
    i4, i3 = {"CMG": (0, 0), "tipekasus": (1, None), "spesifikkasus": (2, 1), "severity": (3, 2)}[part]
    three = parts.getItem(i3) if i3 is not None else dash
    return F.when(n == 4, parts.getItem(i4)).when(n == 3, three).otherwise(dash)


def split_code_columns(df: DataFrame, layout=K.CODE_PARTS) -> DataFrame:
    """Replace each code column by the parts the layout keeps for it.

    Each code is split once into an array column (its own projection, which
    Catalyst keeps separate because the array is read several times), then
    the parts are picked from it."""
    present = [(col, keep) for col, keep in layout if col in df.columns]
    arrays = {f"_parts_{col}": F.split(F.coalesce(F.col(col).cast("string"), F.lit(K.MISSING_TEXT)), "-", -1)
              for col, _ in present}
    df = df.withColumns(arrays)
    new = {}
    for col, keep in present:
        for p in keep:
            expr = _pick(F.col(f"_parts_{col}"), p)
            if col == "kdsa" and p == "severity":
                expr = kdsa_severity(expr)
            new[f"{col}_{p}"] = expr
    return df.withColumns(new).drop(*arrays.keys(), *[col for col, _ in present])
