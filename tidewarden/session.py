"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, below the shared folder of the cluster.

    The shared folder is the one named in `spark.checkpoint.dir`. Only a local session, where
    driver and executors are one process, falls back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes a table below the shared folder and reads it again, so that all that is derived from
    it sees the same rows in the same places, even where executors are lost."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more, in whichever store it lies."""
    jvm, context = spark._jvm, spark.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)


_LOCAL: list[tempfile.TemporaryDirectory] = []  # removed when Python ends


def _local_base() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tidewarden-", ignore_cleanup_errors=True))
    return _LOCAL[0].name
