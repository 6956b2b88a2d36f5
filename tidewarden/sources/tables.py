"""Corpus, id-list and JSON Lines readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden import contracts as C


def scan_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet corpus. With a schema, columns it lacks are null and others are not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def source_schema(df: DataFrame) -> DataFrame:
    """Columns and types of a source, as a table."""
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines by a fixed schema; blank lines are skipped, nothing is inferred."""
    return spark.read.schema(schema).json(path)


# Nulls are written out, so every row has every key; instants as UTC with whole seconds.
_JSON = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'",
}


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replaces the table at a path."""
    df.write.mode("overwrite").options(**_JSON).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to an audit log."""
    df.write.mode("append").options(**_JSON).json(path)


def read_held_out(spark: SparkSession, path: str) -> DataFrame:
    """One source id per line; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("source_id"))
    return lines.where(F.col("source_id") != "")


def write_held_out(ids: DataFrame, path: str) -> None:
    ids.select("source_id").write.mode("append").text(path)


def manifest(
    generated: DataFrame, text: str, generator: Column, prompt: Column, made_at: Column
) -> DataFrame:
    """Manifest rows of generated texts.

    The id is a hash of what the row consists of, so a task that runs again gives the same id.
    """
    prompt_hash = F.sha2(prompt, 256)
    return generated.select(
        F.sha2(F.concat_ws(":", generator, prompt_hash, F.col(text)), 256).alias("id"),
        generator.alias("generator"),
        prompt_hash.alias("prompt_hash"),
        made_at.cast("timestamp").alias("timestamp"),
    )


def write_manifest(rows: DataFrame, path: str) -> None:
    append_jsonl(rows, path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per session, with the time it was written; unreadable files are left out."""
    schema = T.StructType(
        [*C.SESSION.fields, T.StructField("_corrupt_record", T.StringType())]
    )
    files = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .select("*", F.col("_metadata.file_modification_time").alias("modified_at"))
    )
    readable = F.col("_corrupt_record").isNull() & F.col("session_id").isNotNull()
    return files.where(readable).drop("_corrupt_record")
