"""Session construction for tests, benches and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that every local session gets; a cluster session keeps its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with one shuffle partition for each core unless told otherwise."""
    cores = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gridloom").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cores))
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
