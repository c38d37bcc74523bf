"""Functions of the host language as typed operators.

A host function takes pandas Series, one for each declared parameter, and gives a Series of the declared
result: whole Arrow batches go to Python, never single rows. Calls check the number of arguments and cast
them to the declared types; a function that is registered with a session can be called from raw SQL too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .types import Scalar

#: Host functions by name.
FUNCTIONS: dict[str, HostFunction] = {}


class HostFunction:
    def __init__(self, name: str, parameters: list[Scalar], result: Scalar, body: Callable) -> None:
        self.name, self.parameters, self.result = name, parameters, result
        self.udf = F.pandas_udf(body, result.spark)

    def __call__(self, *arguments: Column) -> Column:
        if len(arguments) != len(self.parameters):
            raise TypeError(f"{self.name} takes {len(self.parameters)} arguments")
        return self.udf(*[a.cast(p.spark) for a, p in zip(arguments, self.parameters, strict=True)])

    def register(self, spark: SparkSession) -> str:
        """Make it callable in SQL; the name there has ``_`` for ``::``."""
        from ..sources.tables import Capabilities

        Capabilities.of(spark).require("external")
        own = self.name.replace("::", "_")
        spark.udf.register(own, self.udf)
        return own


def external(name: str, parameters: list[Scalar], result: Scalar) -> Callable[[Callable], HostFunction]:
    """Declare a host function: ``@external("text::checksum", [Int64], Int32)``."""

    def declare(body: Callable) -> HostFunction:
        if name in FUNCTIONS:
            raise ValueError(f"{name} is declared already")
        FUNCTIONS[name] = HostFunction(name, parameters, result, body)
        return FUNCTIONS[name]

    return declare


def lookup(spark: SparkSession, name: str) -> HostFunction:
    """A declared function, if the session may call the host."""
    from ..sources.tables import Capabilities

    Capabilities.of(spark).require("external")
    return FUNCTIONS[name]
