"""Nearest neighbours by collision-counting hashing.

Every hash function is one random projection, kept as a sorted array cut into buckets. A query opens
a window around its own value in each array; virtual rehashing widens all windows round by round. A
vector that falls into enough windows collides, and its exact inner product is computed once. The
rounds end when the windows reach as far as the k-th best vector found. Largest inner product becomes least distance by one more component,
which brings all vectors to the same length.

Collisions are a matter of chance, so a vector nearer than the k-th best found may fall into too few
windows. After the rounds matrix products, with a margin for their rounding, tell which of the others
may be as near, and these are verified like those that collide: the k nearest are all found.

A window is a set of bits, the vectors before its end without those before its begin, and collisions
are counted for 64 vectors at a time by adders of bits, for a few queries side by side.

Vectors are dealt into blocks of bounded size, queries too; a task holds one block of each.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import ship
from tidewarden.llm.vectors import dots, stack, usable

ship(__name__)

PROJECTIONS = 96
COLLISIONS = 62  # windows that a vector must fall into
BUCKETS = 64  # of a sorted array at most; windows end at their borders
BLOCK, QUERIES = 65_536, 4_096
NUMBERS = 1 << 22  # of a block at most: wide vectors have smaller blocks
FEWEST = 256  # queries that are worth a task of their own
SIDE = 512  # vectors whose products are taken at once, so that they stay in the cache
BITS = 1 << 20  # of one window for queries side by side
REACH = 1.05  # half a window over the distance of the k-th best vector, at which the rounds end
FIRST, WIDEN = 0.5, 1.25  # half a window in the first round over the length of the vectors; growth


class Arrays:
    """The sorted arrays of all projections, as sets of the vectors before each bucket."""

    def __init__(self, values: np.ndarray):
        n, count = values.shape
        each = max(1, -(-n // BUCKETS))
        begins = np.arange(0, n, each)
        self.n, self.words = n, -(-n // 64)
        self.starts = np.empty((count, len(begins)))
        self.before = np.zeros((count, len(begins) + 1, self.words), np.uint64)
        bucket = np.empty(n, np.int64)
        for i in range(count):
            order = np.argsort(values[:, i], kind="stable")
            self.starts[i] = values[order[begins], i]
            bucket[order] = np.arange(n) // each
            for j in range(1, len(begins) + 1):
                bits = np.packbits(bucket < j, bitorder="little")
                self.before[i, j].view(np.uint8)[: len(bits)] = bits

    def collide(self, centres: np.ndarray, half: np.ndarray, least: int) -> np.ndarray:
        """Bits of the vectors that fall into at least `least` windows, one row per query."""
        counters = []  # counters[p]: sets that each count 2^p; three become a sum and a carry

        def add(p: int, bits: np.ndarray) -> None:
            if p == len(counters):
                counters.append([])
            counters[p].append(bits)
            if len(counters[p]) == 3:
                x, y, z = counters[p]
                either = x ^ y
                counters[p] = [either ^ z]
                add(p + 1, (x & y) | (either & z))

        for i, starts in enumerate(self.starts):
            low = np.maximum(np.searchsorted(starts, centres[:, i] - half, "left") - 1, 0)
            high = np.searchsorted(starts, centres[:, i] + half, "right")
            add(0, self.before[i, high] & ~self.before[i, low])
        p = 0
        while p < len(counters):  # what is left in pairs
            if len(counters[p]) == 2:
                x, y = counters[p]
                counters[p] = [x ^ y]
                add(p + 1, x & y)
            p += 1
        enough = np.full((len(centres), self.words), ~np.uint64(0))
        for p in range(max(len(counters), least.bit_length())):
            bit = counters[p][0] if p < len(counters) and counters[p] else np.uint64(0)
            enough = enough & bit if least >> p & 1 else enough | bit
        return enough

    def places(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=self.n, bitorder="little"))


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, top: float, k: int):
    """(query position, id, score) of the k nearest vectors of each query, those of its own id left out."""
    n, dim = vectors.shape
    spread = np.sqrt(np.maximum(0, top**2 - (vectors**2).sum(1)))
    axes = np.random.default_rng(7).standard_normal((dim + 1, PROJECTIONS))
    arrays = Arrays(np.concatenate([vectors, spread[:, None]], 1) @ axes)
    norms = np.linalg.norm(queries, axis=1)
    centres = (queries * (top / norms)[:, None]) @ axes[:dim]
    wanted = max(k, 1)
    # More than two sums of the same products can differ by, in whatever order they are taken.
    rounding = 4 * (dim + 1) * np.finfo(float).eps * top * norms + np.finfo(float).tiny
    beside = max(1, BITS // (64 * arrays.words))
    for at in range(0, len(queries), beside):
        batch = np.arange(at, min(at + beside, len(queries)))
        half = np.full(len(batch), top * FIRST if n > k + 1 else np.inf)
        found = [(np.empty(0, np.int64), np.empty(0))] * len(batch)
        known = np.zeros((len(batch), arrays.words), np.uint64)
        open_ = np.arange(len(batch))
        while len(open_):
            bits = arrays.collide(centres[batch[open_]], half[open_], COLLISIONS)
            new = bits & ~known[open_]
            known[open_] |= bits
            still = []
            for b, row in zip(open_.tolist(), new, strict=True):
                q = batch[b]
                near, score = found[b] = verified(vectors, ids, queries[q], own[q], found[b], arrays.places(row))
                if half[b] == np.inf:
                    continue
                if len(near) < wanted:
                    half[b] = half[b] * WIDEN if half[b] < 8 * top else np.inf
                    still.append(b)
                    continue
                far = np.sqrt(max(0, 2 * top * (top - kth(score, wanted) / norms[q])))
                if half[b] < REACH * far:
                    half[b] = min(REACH * far, half[b] * WIDEN)
                    still.append(b)
            open_ = np.array(still, np.int64)
        least = np.array([kth(score, wanted) for _, score in found]) - rounding[batch]
        missed = ~(queries[batch] @ vectors.T < least[:, None])  # what is not a number is verified too
        missed &= np.unpackbits(known.view(np.uint8), axis=1, count=n, bitorder="little") == 0
        for b, row in enumerate(missed):
            q = batch[b]
            near, score = verified(vectors, ids, queries[q], own[q], found[b], np.flatnonzero(row))
            best = np.lexsort((ids[near], -score))[:k]
            yield q, ids[near][best], score[best]


def verified(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, found: tuple, more: np.ndarray) -> tuple:
    """The vectors found and their scores with those of `more` that have another id than the query."""
    more = more[ids[more] != own]
    if not len(more):
        return found
    parts = [dots(vectors[more[i : i + SIDE]], query) for i in range(0, len(more), SIDE)]
    return np.concatenate([found[0], more]), np.concatenate([found[1], *parts])


def kth(score: np.ndarray, k: int) -> float:
    """The k-th best score, or less than any if there are fewer."""
    return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf


def nearest(embeddings: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that `is_query` names.

    Nearness is the inner product; ties go to the smaller vec_id. Rows with a null vec_id, or a
    vector that is null, empty, zero or holds null or non-finite components, take no part; neither
    do rows whose length differs from the longest one. Rows that share a vec_id are all candidates,
    but never of each other. An empty table gives no rows; columns besides vec_id and embedding are
    not read.
    """
    rows = embeddings.select("vec_id", "embedding").where(usable("embedding") & F.col("vec_id").isNotNull())
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asks"), F.max(F.sqrt(squares)).alias("top"), F.max(F.size("embedding")).alias("dim")).first()
    blocks, asking = max(1, ceil(facts["n"] / max(1, min(BLOCK, NUMBERS // (facts["dim"] or 1))))), facts["asks"] or 0
    # Where there are fewer blocks than cores, queries are dealt finer.
    idle = ceil(embeddings.sparkSession.sparkContext.defaultParallelism / blocks)
    parts = max(1, ceil(asking / QUERIES), min(idle, ceil(asking / FEWEST)))
    top = facts["top"] or 1.0
    rows = rows.where(F.size("embedding") == F.lit(facts["dim"]))
    mine = F.xxhash64("vec_id", "embedding")
    data = rows.select("vec_id", "embedding", F.pmod(mine, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asks = rows.where("asks").select("vec_id", "embedding", F.pmod(mine, F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def work(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        asked, own = stack(asked["embedding"]), asked["vec_id"].to_numpy()
        out = list(search(stack(block["embedding"]), block["vec_id"].to_numpy(), asked, own, top, k))
        ask = np.concatenate([np.full(len(i), own[q]) for q, i, _ in out])
        return pd.DataFrame({"query_id": ask, "vec_id": np.concatenate([i for _, i, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    found = asks.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInPandas(work, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
