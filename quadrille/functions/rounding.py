"""Rounding to a number of decimals as SQL engines do it on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """x scaled, rounded half away from zero and scaled back, all in doubles; a small negative number becomes -0.0.

    Spark's own `round` goes through decimals: it has no -0.0, and takes the half of the written number instead of the scaled one.
    """
    return F.signum(x) * F.round(F.abs(x) * 10.0**digits, 0) / 10.0**digits
