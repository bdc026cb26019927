"""Stay length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def stay_days(start: Column | str, end: Column | str) -> Column:
    """Whole days between admission and discharge, floored (not calendar days).

    ``timestamp_diff`` in microseconds is zone-free for timestamp_ntz input,
    so the session time zone cannot shift the result.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    us = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(us / F.lit(DAY_MICROS)).cast("bigint")
