"""Dates, timestamps without zone, times of day (microseconds), durations and decimals of scale 2.

A local time that a zone skips or repeats is resolved by Spark's own rule, or refused where ``strict`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def date(days_epoch: Column) -> Column:
    return F.date_from_unix_date(days_epoch)


def days_epoch(d: Column) -> Column:
    return F.unix_date(d)


def timestamp(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def micros_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def duration(micros: Column) -> Column:
    """A day-time interval of so many microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))


def micros(d: Column) -> Column:
    """Microseconds of a day-time interval."""
    return F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + d)


def date_sub(a: Column, b: Column) -> Column:
    """The duration from ``b`` to ``a``."""
    return a - b


def date_to_timestamp(d: Column, tz: str, strict: bool = False) -> Column:
    """The instant (UTC) of local midnight; ``strict``: an error where the zone has no such time, or has it twice."""
    local = d.cast("timestamp")
    utc = F.to_utc_timestamp(local, tz)
    if strict:
        # Clocks move by half an hour to a day; a repeated time is another instant's too, and a skipped one is none's.
        moved = [F.from_utc_timestamp(utc + F.expr(f"INTERVAL '{sign}{m}' MINUTE"), tz) == local for m in (30, 60, 120, 1440) for sign in ("", "-")]
        twice = moved[0]
        for m in moved[1:]:
            twice = twice | m
        message = F.concat(F.lit("no single instant of local midnight in this zone: "), d.cast("string"))
        utc = F.when((F.from_utc_timestamp(utc, tz) != local) | twice, F.raise_error(message).cast("timestamp")).otherwise(utc)
    return utc.cast("timestamp_ntz")


def year_month_day(d: Column) -> Column:
    return F.struct(F.year(d).alias("year"), F.month(d).cast("short").alias("month"), F.day(d).cast("short").alias("day"))


def timestamp_to_date(ts: Column, tz: str) -> Column:
    """The local date of an instant."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), tz))


def timestamp_sub(a: Column, b: Column) -> Column:
    return a - b


def timezone_offset(tz: str, d: Column) -> Column:
    """Local midnight less UTC midnight, as instants."""
    return date_to_timestamp(d, tz) - date_to_timestamp(d, "UTC")


def time_of_day(ts: Column) -> Column:
    """Microseconds since midnight of a timestamp."""
    return F.pmod(micros_epoch(ts), F.lit(DAY_US))


def time_to_duration(t: Column) -> Column:
    return duration(t)


def time_diff(a: Column, b: Column) -> Column:
    return duration(a - b)


def time_add(t: Column, d: Column) -> Column:
    """A time moved by a duration, within 24 hours."""
    return F.pmod(t + micros(d), F.lit(DAY_US))


def time_sub(t: Column, d: Column) -> Column:
    return F.pmod(t - micros(d), F.lit(DAY_US))


def decimal(x: Column) -> Column:
    """A decimal of scale 2; sums and differences keep it."""
    return x.cast("decimal(19,2)")
