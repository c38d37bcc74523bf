"""Relations over files that keep arriving: the row-wise operators and ``group_map`` as a Structured Streaming query.

The collection language has no streaming construct of its own; these two functions run its operators on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.rel import Rel


def arriving(spark: SparkSession, path: str, schema: T.StructType) -> Rel:
    """Parquet files of a folder as a stream, in no order."""
    return Rel(spark.readStream.schema(schema).parquet(path))


def write(rel: Rel, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    rel.frame().writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def each_batch(rel: Rel, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """As ``write``, with a function for each micro-batch (for sinks that take updates)."""
    rel.frame().writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
