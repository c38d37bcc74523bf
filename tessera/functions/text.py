"""Text in code points; separators and patterns are literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def length(x: Column) -> Column:
    """Code points."""
    return F.char_length(x)


def from_ascii(code: Column) -> Column:
    return F.char(code)


def join(parts: Column, sep: str) -> Column:
    """The texts of an array with ``sep`` between them; empty for none."""
    return F.array_join(parts, sep)


def split(x: Column, sep: str) -> Column:
    """Parts between literal separators; an empty separator gives the characters between two empty ends."""
    if sep == "":
        chars = F.filter(F.split(x, ""), lambda c: c != "")
        return F.concat(F.array(F.lit("")), chars, F.array(F.lit("")))
    return F.split(x, re.escape(sep) if sep.isalnum() else "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def starts_with(x: Column, prefix: Column | str) -> Column:
    return F.startswith(x, _column(prefix))


def contains(x: Column, part: Column | str) -> Column:
    return F.contains(x, _column(part))


def ends_with(x: Column, suffix: Column | str) -> Column:
    return F.endswith(x, _column(suffix))


def _column(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x
