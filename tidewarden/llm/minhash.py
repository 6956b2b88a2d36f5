"""Near duplicates by min-max hashing.

Under each hash function both the least and the greatest value of a document's shingles are kept,
so half as many functions give a signature of the same length with less variance. Bands of the
signature find candidates; links are confirmed on the full shingle sets. Documents of equal sets
form a class first, so copies never meet in a band.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import keep, ship, small_batches
from tidewarden.llm.graph import components

ship(__name__)

FUNCTIONS = 80  # 160 values
BANDS, ROWS = 32, 5  # a pair at similarity 0.8 is missed with probability 3e-6
BASE = 0x100000001B3
CHUNK = 512
SENT = 500_000  # ids of 24 bytes that are broadcast; more are joined by a shuffle


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case."""
    data = (text or "").encode("utf-8", "replace").lower()
    found = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not found:
        return np.empty(0, np.int64)
    ids = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(found)}
    one = np.array([ids[w] for w in found], np.uint64)
    width = min(words, len(one))
    key = np.full(len(one) - width + 1, len(one) if len(one) < words else words, np.uint64)
    for i in range(width):
        key = mix((key * np.uint64(BASE)) ^ one[i : len(one) - width + 1 + i])
    return np.unique(key).view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(values: np.ndarray, functions: int = FUNCTIONS, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of the signature; the minimum and the maximum of a function fall into
    different bands, as they are not independent in small sets."""
    seeds = np.random.default_rng(20240607).integers(1, 1 << 63, (functions, 2), np.uint64, endpoint=False)
    xor, factor = seeds[:, 1, None], seeds[:, 0, None] | np.uint64(1)
    low, high = np.full(functions, np.iinfo(np.uint64).max), np.zeros(functions, np.uint64)
    for i in range(0, len(values), CHUNK):  # all functions at once, over as many shingles as fit the cache
        hashed = values[None, i : i + CHUNK].view(np.uint64) ^ xor
        hashed *= factor
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    parts = np.concatenate([low, high])[: count * rows].reshape(count, rows)
    key = np.arange(1, count + 1).astype(np.uint64)
    for i in range(rows):
        key = mix((key * np.uint64(BASE)) ^ parts[:, i])
    return key.view(np.int64)


def set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _sign(words: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch[i : i + 256]
                sets = [shingles(t, words) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_shingles": [len(s) for s in sets],
                        "set_key": [set_key(s) for s in sets],
                        "bands": [bands(s).tolist() if len(s) else None for s in sets],
                    }
                )

    return work


def _sets(words: int):
    """The full sets of the documents that stand for a class."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch[i : i + 256]
                sets = [shingles(t, words) for t in part["text"]]
                out = pd.DataFrame({"a": part["doc_id"], "set_key": part["set_key"], "shingles": [s.tolist() for s in sets]})
                yield out[[set_key(s) == k for s, k in zip(sets, part["set_key"], strict=True)]]

    return work


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = pairs.join(sets.select("a", F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("a").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def rare_pairs(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) of members (a, n, component) of different components that share one of
    their rarest shingles.

    With the shingles of all members in one order, rarest first, two sets that reach the similarity
    share one among the first n - ceil(n * percent / 100) + 1 of each. For two given sizes the links
    need a larger overlap, so the first shingle that they share must stand even earlier. So no link
    is lost, and a passage that very many members share brings together only those that hold little
    else. `sets` (a, set_key, shingles) holds each set of a member once; places are counted in a set.
    """
    each = sets.select("a", "set_key", F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("shingle"))
    each = member.join(each, ["a", "n"])
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("a", "set_key").orderBy("often", "shingle"))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    each = each.join(often, "shingle").withColumn("place", place).where(F.col("place") <= head).where("often > 1")
    apart = each.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    each = keep(each.select("shingle", "a", "n", "component", "place").join(apart.select("shingle"), "shingle"), "rare")
    other = each.select("shingle", F.col("a").alias("b"), F.col("n").alias("m"), F.col("component").alias("d"), F.col("place").alias("place_b"))
    overlap = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    early = (F.col("place") <= F.col("n") - overlap + 1) & (F.col("place_b") <= F.col("m") - overlap + 1)
    return each.join(other, "shingle").where("component < d").where(early).select("a", "b", "n", "m")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Documents without words (null and empty texts too) are linked with nothing. doc_id names a
    document; if it comes with several texts, classes that share their least doc_id count as one. A null doc_id is never linked; its component_id is null and
    it is kept. An empty table gives no rows; columns besides doc_id and text are not read.

    Links: in each bucket all classes are compared with the least one first, so a large group of
    copies costs as many comparisons as it has members. Classes of buckets that these links leave
    apart are compared across components if they share a rare shingle; no link is lost by that.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    signed = rows.mapInPandas(_sign(words), "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")
    signed = keep(signed, "signed")
    # A class is named by its least doc_id. Equal sets have equal bands.
    keyed = signed.where("set_key is not null and doc_id is not null")
    named = keyed.groupBy("set_key").agg(F.min("doc_id").alias("a"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    named = keep(named, "classes")
    banded = named.select("a", "n", F.posexplode("bands").alias("band", "key"))
    centre = banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("a").alias("b"), F.min_by("n", "a").alias("m")).where("size > 1")
    shared = keep(banded.join(centre.drop("size"), ["band", "key"]), "buckets")
    least = named.select("set_key", "a")
    # Texts are read again only for classes that share a bucket.
    wanted = keep(least.join(shared.select("a").distinct(), "a", "left_semi").withColumnRenamed("a", "doc_id"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    first = rows.join(wanted, "doc_id").mapInPandas(_sets(words), "a bigint, set_key binary, shingles array<bigint>")
    first = keep(first.dropDuplicates(["a", "set_key"]), "sets")  # a row may come several times
    ratio = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    star = shared.where("a != b").where(ratio)
    links = keep(confirm(star.select("a", "b").distinct(), first, percent), "links")
    joined = components(links)
    member = shared.select("band", "key", "a", "n").join(joined.withColumnRenamed("node", "a"), "a", "left")
    member = member.withColumn("component", F.coalesce("component", "a"))
    mixed = member.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    member = member.join(mixed.select("band", "key"), ["band", "key"]).select("a", "n", "component").distinct()
    rest = rare_pairs(keep(member, "mixed"), first, percent).where(ratio).select("a", "b").distinct()
    rest = rest.join(star.select("a", "b").distinct(), ["a", "b"], "left_anti")
    rest = rest.join(star.select(F.col("a").alias("b"), F.col("b").alias("a")).distinct(), ["a", "b"], "left_anti")
    links = links.unionByName(confirm(rest, first, percent))
    final = components(links).withColumnRenamed("node", "a")
    named = least.join(final, "a", "left").select("set_key", F.coalesce("component", "a").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
