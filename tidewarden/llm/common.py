"""Helpers that the operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.session import remove, scratch_dir

BATCH = 1024  # rows


def ship(module: str) -> None:
    """Sends a module's functions with the job, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python some at a time: whole texts of Spark's 10,000 rows take tens of megabytes in
    the JVM, as a batch and as Python strings, and workers that later stages share keep the room."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes a table below the shared folder and reads it again: cuts lineage, survives executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Removes tables that `keep` wrote, once all that was made of them is written itself."""
    for table in tables:
        remove(table.sparkSession, table.kept_at)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """Writes a table with a dense number from 0, in the order of its partitions and their rows.

    The first numbers come from one count per partition, so what is broadcast has one row per task.
    """
    place = F.monotonically_increasing_id()
    kept = keep(df.withColumn("_place", place), label).withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows"))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).select(name, *df.columns)
