"""Conversions: integers wrap at the target's width, floats truncate and saturate, texts have no exponent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Bool, Float32, Float64, Scalar, Text


def wrap(x: Column, target: Scalar) -> Column:
    """An integer reduced to the target's width (two's complement if it is signed)."""
    if target.bits == 64:
        wide = x.cast("decimal(38,0)")
        size = F.lit(str(1 << 64)).cast("decimal(38,0)")
        low = F.pmod(wide, size)
        return (F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - size).otherwise(low) if target.signed else low).cast(target.spark)
    # Only the low bits matter, so a Uint64 first becomes its 64-bit pattern.
    long = x.cast("decimal(38,0)")
    low = F.pmod(long, F.lit(1 << target.bits).cast("decimal(38,0)")).cast("long")
    return (F.when(low >= 1 << (target.bits - 1), low - (1 << target.bits)).otherwise(low) if target.signed else low).cast(target.spark)


def wrap_long(x: Column, target: Scalar) -> Column:
    """``wrap`` for sources of at most 64 bits, by shifts alone."""
    if target.bits >= 64:
        return wrap(x, target)
    shift = 64 - target.bits
    left = F.shiftleft(x.cast("long"), shift)
    return (F.shiftright(left, shift) if target.signed else F.shiftrightunsigned(left, shift)).cast(target.spark)


def bounds(target: Scalar) -> tuple[int, int]:
    return (-(1 << (target.bits - 1)), (1 << (target.bits - 1)) - 1) if target.signed else (0, (1 << target.bits) - 1)


def saturate(x: Column, target: Scalar) -> Column:
    """A float truncated toward zero and held within the target's range; NaN becomes 0."""
    low, high = bounds(target)
    x = x.cast("double")
    held = F.when(F.isnan(x), F.lit(0)).when(x >= float(high), F.lit(str(high)).cast(target.spark)).when(x <= float(low), F.lit(str(low)).cast(target.spark))
    inside = F.least(F.greatest(F.when(F.isnan(x), 0.0).otherwise(x), F.lit(float(low))), F.lit(float(high)))
    # The clamp above keeps the cast within range even where both branches are evaluated.
    safe = F.when((x < float(high)) & (x > float(low)), inside).otherwise(F.lit(0.0))
    return F.when(x.isNull(), None).otherwise(held.otherwise(safe.cast("decimal(38,6)").cast("decimal(20,0)") if target.bits == 64 and not target.signed else safe.cast("long"))).cast(target.spark)


def to(x: Column, target: Scalar, source: Scalar) -> Column:
    """Convert a value of type ``source`` to type ``target``."""
    if target is Text:
        return to_text(x, source)
    if target in (Float32, Float64):
        return x.cast(target.spark)
    if source in (Float32, Float64):
        return saturate(x, target)
    return wrap(x, target) if source.bits == 64 and not source.signed else wrap_long(x, target)


def to_text(x: Column, source: Scalar) -> Column:
    """Text of a value: floats without exponent or a trailing ``.0``, booleans ``true`` or ``false``."""
    if source in (Float32, Float64):
        text = x.cast("string")
        plain = F.when(text.contains("E") | text.contains("e"), _expand(text)).otherwise(text)
        return F.when(F.isnan(x), F.lit("NaN")).when(text.isin("Infinity", "-Infinity"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.regexp_replace(plain, r"\.0$", ""))
    if source is Bool:
        return x.cast("string")
    return x.cast("string")


def _expand(text: Column) -> Column:
    """Decimal digits of a number in scientific notation, by moving the point."""
    sign = F.regexp_extract(text, "^(-?)", 1)
    whole, part = F.regexp_extract(text, r"^-?(\d+)", 1), F.regexp_extract(text, r"\.(\d+)E", 1)
    part = F.when(part == "0", "").otherwise(part)
    power = F.expr("0") + F.when(text.rlike("E-?[0-9]+$"), F.regexp_extract(text, r"E(-?\d+)$", 1)).otherwise("0").cast("int")
    digits = F.concat(whole, part)
    point = F.length(whole) + power
    grown = F.concat(digits, F.repeat(F.lit("0"), F.greatest(point - F.length(digits), F.lit(0))))
    large = F.when(point >= F.length(grown), grown).otherwise(F.concat(F.substring(grown, F.lit(1), F.greatest(point, F.lit(0))), F.lit("."), F.substring(grown, point + 1, F.length(grown))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)
    return F.concat(sign, F.when(point > 0, large).otherwise(small))
