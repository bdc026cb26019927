"""Imputation: fit (modes, exact medians) and apply.

Fitting produces a handful of scalars (one per column); they are gathered to
the driver as fitted parameters, the way MLlib's own ``Imputer`` keeps its
surrogates, and applied as literals so the transform stays a narrow,
codegen-friendly projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.prefix import exact_medians, modes, stack


def mode_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, mode) per column, values compared as text."""
    return modes(stack(df, cols, cast="string"))


def median_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, median) per column, exact."""
    return exact_medians(stack(df, cols, cast="double", value="x"))


def collect_params(table: DataFrame, value: str) -> dict:
    """Tiny fitted-parameter table (one row per column) to a dict."""
    return {r["name"]: r[value] for r in table.collect()}


def fill(df: DataFrame, values: dict, cast: dict | None = None) -> DataFrame:
    cast = cast or {}
    out = {}
    for c, v in values.items():
        if c not in df.columns or v is None:
            continue
        lit: Column = F.lit(v)
        if c in cast:
            lit = lit.cast(cast[c])
        out[c] = F.coalesce(F.col(c), lit)
    return df.withColumns(out) if out else df
