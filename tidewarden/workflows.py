"""The whole jobs: draw an inbox, turn its labels into approved rows, check a rule-set folder.

The inbox is a file because people label between the first two.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden import contracts as C
from tidewarden.operators import labels, profile, sampling, validation
from tidewarden.sources import rule_sets, tables

# Fixed value: the name of the stream position in inbox and label files.
STREAM_IDX = "_stream_idx"


def write_inbox(
    corpus: DataFrame,
    key: str,
    path: str,
    seed: int = C.SAMPLE_SEED,
    scan_rows: int = C.SAMPLE_SCAN_ROWS,
    targets: Mapping[str, int] = C.BUCKET_TARGETS,
    regime: str = "chat",
) -> DataFrame:
    """Draws the stratified sample into a JSON Lines table; returns how full the buckets are."""
    picked = sampling.stratified_sample(corpus, key, seed, scan_rows, targets, regime)
    tables.write_jsonl(picked.withColumnRenamed("stream_idx", STREAM_IDX), path)
    return profile.bucket_fill(read_inbox(corpus.sparkSession, path), targets)


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    in_file = {"stream_idx": STREAM_IDX}
    schema = T.StructType(
        [T.StructField(in_file.get(f.name, f.name), f.dataType) for f in C.INBOX.fields]
    )
    return tables.read_jsonl(spark, path, schema).withColumnRenamed(STREAM_IDX, "stream_idx")


def read_labels(spark: SparkSession, path: str, lax: bool = False) -> DataFrame:
    """Label lines, each a stream position and a judgment -> stream_idx, judgment, errors."""
    # A field read as text keeps the JSON of its value.
    schema = T.StructType(
        [T.StructField(STREAM_IDX, T.LongType()), T.StructField("judgment", T.StringType())]
    )
    lines = tables.read_jsonl(spark, path, schema)
    lines = lines.select(F.col(STREAM_IDX).alias("stream_idx"), F.col("judgment").alias("line"))
    return validation.parse_judgment(lines, "line", lax=lax).drop("line")


@dataclass(frozen=True)
class Review:
    """The approved rows as written, and the reports a reviewer reads."""

    rows: DataFrame
    summary: DataFrame
    buckets: DataFrame
    lines: DataFrame


def approve_labels(
    inbox: DataFrame,
    judged: DataFrame,
    path: str,
    session_id: str,
    timestamp: Column,
    slug: str,
    regime: str,
    source: str,
    author: str,
) -> Review:
    """Joins inbox and labels and writes the approved rows, or raises and writes nothing.

    It raises if keys are missing, left over or repeated, or if any judgment breaks the contract.
    """
    labels.require_complete(inbox, judged)
    joined = validation.gate_all_or_nothing(labels.attach_labels(inbox, judged))
    approved = labels.build_approved_row(
        joined, session_id, timestamp, slug, regime, source, author
    )
    tables.write_jsonl(approved, path)
    rows = tables.read_jsonl(inbox.sparkSession, path, C.APPROVED_ROW)
    return Review(
        rows=rows,
        summary=profile.audit_summary(rows),
        buckets=profile.bucket_breakdown(rows, "content.bucket", "judgment.violates_policy"),
        lines=labels.review_row(rows),
    )


def check_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """A report row per rule-set file, failures included; raises if there are no files."""
    loaded = rule_sets.load_rule_sets(spark, path)
    return profile.catalog_report(validation.require_nonempty(loaded, path))
