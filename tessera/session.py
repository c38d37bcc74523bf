"""Sessions and the loading of driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, and those that let one plan suit small and large inputs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """The session with this engine's settings; ``master`` only where no cluster gives one."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
