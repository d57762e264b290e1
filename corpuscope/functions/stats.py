"""Aggregate expressions with engine-independent rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def avg6(c) -> Column:
    """Mean of values already rounded to 6 decimals, rounded half-up to 6 decimals.

    Summing integer micro-units is exact, so the result does not depend on
    summation order or on how an engine rounds a binary tie such as 0.5120885.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.sum(F.round(c * 1_000_000).cast("long"))
    n = F.count(c)
    return F.floor((F.lit(2) * s + n) / (F.lit(2) * n)) / F.lit(1_000_000.0)
