"""Logical scalar types over Spark's: unsigned integers, decimals, durations, and defaults.

Unsigned types are stored in the next wider signed type (Uint64 as decimal(20,0)) and wrap at their width.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    """A scalar type: its name, the Spark type that stores it, and for integers width and sign."""

    name: str
    spark: T.DataType
    bits: int = 0
    signed: bool = True

    @property
    def is_int(self) -> bool:
        return self.bits > 0


Bool = Scalar("Bool", T.BooleanType())
Int8, Int16, Int32, Int64 = (Scalar(f"Int{b}", t, b) for b, t in ((8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())))
Uint8, Uint16, Uint32, Uint64 = (Scalar(f"Uint{b}", t, b, False) for b, t in ((8, T.ShortType()), (16, T.IntegerType()), (32, T.LongType()), (64, T.DecimalType(20, 0))))
Float32, Float64 = Scalar("Float32", T.FloatType()), Scalar("Float64", T.DoubleType())
Text = Scalar("Text", T.StringType())
Date = Scalar("Date", T.DateType())
Time = Scalar("Time", T.LongType())  # microseconds since midnight
Duration = Scalar("Duration", T.DayTimeIntervalType())
Timestamp = Scalar("Timestamp", T.TimestampNTZType())
DecimalType = Scalar("Decimal", T.DecimalType(19, 2))
INTS = [Int8, Int16, Int32, Int64, Uint8, Uint16, Uint32, Uint64]
NUMBERS = [*INTS, Float32, Float64]


def default_value(kind: T.DataType):
    """The usual default as a Python value: false, zero, empty, or the fields' defaults."""
    if isinstance(kind, T.StructType):
        return tuple(default_value(f.dataType) for f in kind)
    plain = {T.BooleanType: False, T.StringType: "", T.DateType: date(1970, 1, 1), T.TimestampNTZType: datetime(1970, 1, 1), T.TimestampType: datetime(1970, 1, 1), T.DayTimeIntervalType: timedelta(0), T.DecimalType: Decimal(0)}
    if isinstance(kind, T.ArrayType):
        return []
    return plain.get(type(kind), 0)


def default_for(kind: T.DataType | Scalar) -> Column:
    """The default as a Column of that type; of a tagged union, its first variant."""
    kind = kind.spark if isinstance(kind, Scalar) else kind
    if isinstance(kind, T.StructType):
        tagged = kind.names[:1] == ["_t"]
        fields = [F.lit(0).cast("short").alias("_t") if f.name == "_t" else (F.lit(None).cast(f.dataType) if tagged else default_for(f.dataType)).alias(f.name) for f in kind]
        if tagged and len(kind) > 1 and kind[1].metadata.get("variant") == 0:
            fields[1] = default_for(kind[1].dataType).alias(kind[1].name)
        return F.struct(*fields)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(default_value(kind)).cast(kind)
