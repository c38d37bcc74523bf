"""Arithmetic, comparison and logic. Integer overflow raises (ANSI mode); ``/`` truncates on integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Float32, Float64, Scalar

LESS, EQUAL, GREATER = 0, 1, 2


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column, kind: Scalar) -> Column:
    """True division of floats; of integers, truncated toward zero and of the operands' type."""
    if kind in (Float32, Float64):
        return (a / b).cast(kind.spark)
    if kind.bits == 64 and not kind.signed:  # a decimal quotient is rounded, unless it is whole
        return ((a - a % b) / b).cast(kind.spark)
    return _infix("div", a, b).cast(kind.spark)


def _infix(op: str, a: Column, b: Column) -> Column:
    return F.call_function(op, a, b)


def mod(a: Column, b: Column) -> Column:
    """The remainder, with the sign of the dividend."""
    return a % b


def neg(a: Column) -> Column:
    return -a


def cmp(a: Column, b: Column) -> Column:
    """0, 1 or 2 for less, equal or greater; on structs field by field, on arrays by prefix then length."""
    return F.when(a < b, LESS).when(a > b, GREATER).otherwise(EQUAL).cast("short")


def eq(a: Column, b: Column) -> Column:
    """Equality that is never null: none equals none."""
    return a.eqNullSafe(b)


def ieee_eq(a: Column, b: Column) -> Column:
    """Float equality in which NaN differs from itself."""
    return (a == b) & ~F.isnan(a)


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def not_(a: Column) -> Column:
    return ~a


def if_(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def match(x: Column, *cases: tuple[object, Column], otherwise: Column | None = None) -> Column:
    """Branches on literals (a tuple or list of alternatives fits any of them) or on conditions (Column -> Column)."""
    out = F
    for pattern, value in cases:
        if isinstance(pattern, Callable):
            fits = pattern(x)
        elif isinstance(pattern, (tuple, list)):
            fits = x.isin(*pattern)
        else:
            fits = x == pattern
        out = out.when(fits, value)
    return out if otherwise is None else out.otherwise(otherwise)


def range_(start: Column | None, end: Column | None, kind: str = "long") -> Column:
    """A range ``start..end`` of two options."""
    none = F.lit(None).cast(kind)
    return F.struct((none if start is None else start).alias("start"), (none if end is None else end).alias("end"))
