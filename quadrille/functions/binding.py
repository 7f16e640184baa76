"""Values bound to a name within one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
