"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local masters get a temporary one; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[0])
        where = _own[0]
    return where.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    with suppress(Exception):  # the JVM may have gone first
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again; it survives lost executors, and goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
