"""Integer and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column | int) -> Column:
    """Integer division rounding toward minus infinity, for positive ``b`` (``div`` truncates)."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))
