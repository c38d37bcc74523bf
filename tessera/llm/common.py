"""What the training-data operators share: the folder for written tables, staging and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are looked at together, and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Bytes from which a piece of a worker's memory is the system's own.
MAPPED = 4 << 20
#: Texts from which tables of frequent strings are made, and the bytes of the longest of them: the driver gets 64 MiB at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4_096, 16 << 10
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local masters get a temporary one; elsewhere that is an error."""
    global _own_dir
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dir)
        where = _own_dir
    return where.rstrip("/")


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def prepare(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES`` bytes (Spark's own bound is 64 MiB), for rows that are worked on when the caller asks.

    Spark reads this when a plan runs, so it cannot be restored before; it changes no result.
    """
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES, "64m")) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def shuffle_files_removed(spark: SparkSession):
    """Within, the shuffle files of each finished action go at once instead of at the next driver GC."""
    return _set(spark, _CLEANUP, "true")


class Workspace:
    """Written tables of one operator call, under the shared folder; what is left of them goes when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` as Parquet, cutting its lineage; the table read back, and its path."""
        if not self.count:
            atexit.register(self._end, self.spark._jvm, self.spark._jsc.hadoopConfiguration())
        self.count += 1
        path = f"{self.root}/{self.count}"
        with shuffle_files_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        """Remove a table that no later step reads."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def clear(self, but: str | None = None) -> None:
        """Remove all tables, once no later step reads them; ``but``: the path of one that stays."""
        for i in range(1, self.count + 1):
            if f"{self.root}/{i}" != but:
                self.drop(f"{self.root}/{i}")

    def _end(self, jvm, conf) -> None:
        with suppress(Exception):  # the JVM may have gone first
            target = jvm.org.apache.hadoop.fs.Path(self.root)
            target.getFileSystem(conf).delete(target, True)


@contextmanager
def memory_returned(*caches) -> Iterator[None]:
    """Large pieces of memory go back to the system when freed; at the end of a task, caches are emptied and the rest goes back: a Python worker lives on and serves other stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc only; -3 is M_MMAP_THRESHOLD, which then no longer grows
        libc.mallopt(-3, MAPPED)
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, a few at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def some_texts(docs: DataFrame, text_col: str) -> list[str]:
    """A bounded number of texts of bounded size, from which tables that only save work are made; the rest of ``docs`` is not read."""
    return [r.text for r in docs.select(text_of(text_col).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE_ROWS)]


def row_of(names: list[str]) -> Column:
    """Columns as one, ``row``, so that their names clash with nothing that stands beside it."""
    return F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null ids count as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
