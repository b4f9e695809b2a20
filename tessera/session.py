"""A session with the settings that the library's results rest on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: object) -> SparkSession:
    """UTC, adaptive execution and Arrow; more settings by name, dots written as two underscores."""
    builder = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local session without one gets its own, a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is worked out once and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
