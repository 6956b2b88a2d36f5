"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import bpe, line_dedup, minhash, mixing, quality, queries
from tidewarden.llm.common import keep, table


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row: rows without an id take a hash of their text, above 2^62, so
    that the decisions of a stage reach them. Such rows of equal text share it."""
    own = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    return docs.select(F.coalesce("doc_id", own).alias("doc_id"), "text", whole)


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, each judged by its own text."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    good = quality.scorer(docs, labels)
    return docs.where(good("text") >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without later copies of passages; n_chars follows the text."""
    found = line_dedup.dedup(docs, min_words=50)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8). Rows without a
    doc_id are documents of their own: of those with equal text one stays, unless it has no words."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    words = F.col("doc_id").isNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    least = docs.where(words).groupBy("text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("least"))
    one = least.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", *[F.col("least")[c].alias(c) for c in rest])
    docs = docs.where(~words).unionByName(one.select(docs.columns))
    rows = named(docs)
    copies = minhash.near_duplicates(rows, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return rows.join(copies, "doc_id", "left_anti").select("row.*")


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws; those without a doc_id are drawn by their text."""
    labelled = queries.languages(docs, table(spark, sf_dir, "labels"))
    return mixing.drawn(named(docs), labelled, queries.WEIGHTS, carried=("row",)).where("taken").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian 32-bit), their number and digests."""
    return bpe.encode(docs, *queries.public_ranks(), ids=True)


STAGES = [
    ("quality", drop_rejected),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_languages),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
