"""Quality by nearest labelled neighbours in a latent semantic space.

A text becomes hashed counts of its byte trigrams and of the shapes of its words, weighted by
log(1 + count) and the rarity of the feature. A truncated singular value decomposition of a bounded
labelled sample gives the latent space. The sample's vectors are broadcast; every document takes
exact blocked cosine products with all of them, and its nearest neighbours vote with weights that
grow with the cosine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import ship, small_batches

ship(__name__)

BUCKETS = 2048
SHAPES = 64
WIDTH = BUCKETS + SHAPES
LATENT = 64
SAMPLE = 6_000  # labelled rows at most; their 2,112 counts each reach the driver compressed
BLOCK = 500  # rows that are unpacked at a time
NEIGHBOURS = 25
SHARPNESS = 30.0


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts, one row per text: byte trigrams, then shares of characters and lines."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        text = text or ""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        for i in range(0, max(0, len(data) - 2), 1 << 20):
            part = data[i : i + (1 << 20) + 2].astype(np.uint32)
            if len(part) > 2:
                key = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA6B)) ^ (part[2:] * np.uint32(0xC2B2AE35))
                row[:BUCKETS] += np.bincount((key * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=BUCKETS)
        row[BUCKETS:] = shape(text, data)
    return out


def shape(text: str, data: np.ndarray) -> np.ndarray:
    """Shares in 0..1: upper case, digits, marks, repeated lines and words, and length steps."""
    out = np.zeros(SHAPES, np.float32)
    if not len(data):
        out[0] = 1
        return out
    kinds = np.bincount(data, minlength=256) / len(data)
    out[1] = kinds[65:91].sum()
    out[2] = kinds[48:58].sum()
    out[3] = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    out[4] = kinds[128:].sum()
    out[5] = kinds[10]
    out[6] = kinds[32]
    lines = [x for x in text.split("\n") if x]
    out[7] = 1 - len(set(lines)) / max(1, len(lines))
    words = text.split()
    out[8] = 1 - len(set(words)) / max(1, len(words))
    out[9] = min(1.0, len(data) / max(1, len(words)) / 40)
    out[10] = len(re.findall(r"[!?#$%*&.]{3,}|!!", text)) / max(1, len(words))
    out[11 + min(20, int(np.log2(1 + len(words))))] = 0.5
    return out


def unpacked(sample: list[bytes]) -> Iterator[np.ndarray]:
    """The rows of counts, a block at a time."""
    for i in range(0, len(sample), BLOCK):
        yield np.stack([np.frombuffer(zlib.decompress(x), np.float32) for x in sample[i : i + BLOCK]])


class Space:
    """The latent space: rarity weights and directions of the labelled sample. The sample comes as
    packed rows and is unpacked block by block; only the Gram matrix is held whole."""

    def __init__(self, sample: list[bytes], latent: int = LATENT) -> None:
        present = sum((rows[:, :BUCKETS] > 0).sum(0) for rows in unpacked(sample))
        self.rarity = np.log((1 + len(sample)) / (1 + present)).astype(np.float32) + 0.1
        gram = np.zeros((WIDTH, WIDTH), np.float32)
        for rows in unpacked(sample):
            weighted = self.weighted(rows)
            gram += weighted.T @ weighted
        _, vectors = np.linalg.eigh(gram)
        self.directions = vectors[:, ::-1][:, :latent].copy()

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        grams = np.log1p(rows[:, :BUCKETS]) * self.rarity
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        shapes = rows[:, BUCKETS:] * 2
        return np.concatenate([grams, shapes / np.maximum(1, np.linalg.norm(shapes, axis=1, keepdims=True))], 1)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = self.weighted(rows) @ self.directions
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def vote(queries: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest vectors, each weighted by exp(sharpness * cosine)."""
    k = min(neighbours, len(labels))
    out = np.empty(len(queries))
    for i in range(0, len(queries), 512):
        cosine = queries[i : i + 512] @ vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, 1).astype(np.float64) - 1))
        out[i : i + 512] = (weight * labels[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def fit(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[Space, np.ndarray, np.ndarray] | None:
    """The space, the vectors and the labels of at most `sample` labelled documents, drawn by a hash
    of doc_id; None without a usable one. `labelled`: doc_id, label (0 or 1). Rows with a null id or
    label take no part; of several labels of one document the greatest counts, of several texts the
    least by hash.

    The ids are drawn first, so that only the texts of the sample leave their place.
    """
    labelled = labelled.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = labelled.join(documents.select("doc_id"), "doc_id", "left_semi")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size bounds the broadcast
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch[i : i + 500]
                packed = [zlib.compress(r.tobytes(), 1) for r in counts(list(part["text"]))]
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"].astype("int32"), "counts": packed})

    rows = texts.select("doc_id", "text", "label").mapInPandas(work, "doc_id bigint, label int, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    packed = [bytes(r["counts"]) for r in rows]
    space = Space(packed)
    vectors = np.concatenate([space.vectors(block) for block in unpacked(packed)])
    return space, vectors, np.array([r["label"] for r in rows], np.float64)


def scorer(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE):
    """A function of a text column that gives the score (0 to 1, higher where label 1 is likelier)."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labelled, sample))

    def work(texts: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series(np.full(len(texts), 0.5))
        space, vectors, labels = sent.value
        blocks = [vote(space.vectors(counts(list(texts[i : i + 512]))), vectors, labels) for i in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(blocks) if blocks else [])

    return F.pandas_udf(work, "double")


def score(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher where label 1 is likelier), predicted.

    Empty and null texts are scored like any other by the features that an empty text has. Without
    any usable label every score is 0.5. Repeated rows give repeated rows, an empty table none;
    columns besides doc_id and text are not read.
    """
    of = scorer(documents, labelled, sample)
    rows = documents.select("doc_id", of("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
