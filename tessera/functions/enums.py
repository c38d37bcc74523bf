"""Tagged unions: a struct of the tag ``_t`` and a nullable payload for each variant that has one.

The tag comes first, so Spark's own order and equality of structs are those of the union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Enum:
    """A union type; ``variants`` maps names to payload types, None for variants without one."""

    def __init__(self, **variants: T.DataType | None) -> None:
        self.variants = variants
        self.names = list(variants)

    @property
    def type(self) -> T.StructType:
        payloads = [T.StructField(n, t, True, {"variant": i}) for i, (n, t) in enumerate(self.variants.items()) if t is not None]
        return T.StructType([T.StructField("_t", T.ShortType(), False), *payloads])

    def tag(self, name: str) -> int:
        return self.names.index(name)

    def of(self, name: str, payload: Column | None = None) -> Column:
        """A value of the variant ``name``."""
        fields = [F.lit(self.tag(name)).cast("short").alias("_t")]
        fields += [(payload.cast(t) if n == name and payload is not None else F.lit(None).cast(t)).alias(n) for n, t in self.variants.items() if t is not None]
        return F.struct(*fields)

    def is_(self, x: Column, name: str) -> Column:
        return x["_t"] == self.tag(name)

    def match(self, x: Column, otherwise: Column | None = None, **cases: Column | Callable[[Column], Column]) -> Column:
        """A branch for each named variant; a function gets the payload."""
        out = F
        for name, case in cases.items():
            out = out.when(self.is_(x, name), case(x[name]) if isinstance(case, Callable) and not isinstance(case, Column) else case)
        return out if otherwise is None else out.otherwise(otherwise)
