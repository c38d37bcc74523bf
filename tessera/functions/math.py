"""Numbers: absolute value, power, constants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def pi(kind: str = "double") -> Column:
    """The constant, as ``double`` or ``float``."""
    return F.lit(PI).cast(kind)


def abs_(x: Column) -> Column:
    return F.abs(x)


def pow_(value: Column, exponent: Column, integer: bool = False) -> Column:
    """``value`` to the power of ``exponent``; exact for integers whose result fits 64 bits."""
    if not integer:
        return F.pow(value, exponent)
    one = F.lit(1).cast("long")
    steps = F.when(exponent > 0, F.sequence(F.lit(1), exponent.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, one, lambda acc, _: acc * value.cast("long"))
