"""Options as nullable columns: null is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import Scalar, default_for


def some(x: Column) -> Column:
    return x


def none(kind: T.DataType | Scalar) -> Column:
    return F.lit(None).cast(kind.spark if isinstance(kind, Scalar) else kind)


def is_some(x: Column) -> Column:
    return x.isNotNull()


def is_none(x: Column) -> Column:
    return x.isNull()


def or_else(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def or_default(x: Column, kind: T.DataType | Scalar) -> Column:
    return F.coalesce(x, default_for(kind))


def map_(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(x.isNotNull(), f(x))


def flat_map(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(x.isNotNull(), f(x))


def map_or(x: Column, default: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(x.isNotNull(), f(x)).otherwise(default)


def zip_(a: Column, b: Column) -> Column:
    """A pair if both are there."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("_0"), b.alias("_1")))
