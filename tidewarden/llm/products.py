"""Exact top-k inner products by norm-bucketed retrieval.

All vectors are sorted by length, longest first, and cut into buckets of equal size; a few buckets in
a row are a run, which one task holds. A query has a threshold: the k-th best score found so far,
first among the longest vectors. In a bucket it becomes a local cosine threshold, the threshold over
the query's length times the bucket's greatest. Above one no vector of the bucket, nor of any later
one, can reach the threshold. Otherwise the bucket is pruned in one of two ways, whichever leaves
less to verify: by length (vectors long enough), or by coordinates (a unit vector at least as near
as the threshold has each coordinate within an interval around the query's). What is left is
verified by exact products, in blocks.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import keep, numbered, ship

ship(__name__)

BUCKET = 4096  # vectors
RUN = 8  # buckets that a task holds at most
QUERIES = 8192  # that a task holds at most
BLOCK = 256  # queries whose products with a bucket are held at once
FOCUS = 4  # coordinates that prune
GATHER = 6  # verifying a vector picked by coordinates costs as much as so many in a row
LONGEST = 2.0**31  # vectors; the scores of shorter ones fit a long
CELLS = 1 << 23  # numbers of a run at most
SPANS = 256  # steps of the table of greatest lengths
SLACK = 1e-9  # relative; bounds of lengths are rounded
LOWEST = -(1 << 63)


class Bucket:
    """Vectors in the order of their ids, so that of equal scores the first ones win."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], np.ascontiguousarray(vectors[order]), norms[order]
        self.top = float(norms.max())
        self.sorted = {}

    def axis(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' places and values in ascending order of one coordinate."""
        if i not in self.sorted:
            values = self.vectors[:, i] / np.maximum(self.norms, 1e-300)
            order = values.argsort()
            self.sorted[i] = order, values[order]
        return self.sorted[i]


def products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; whole numbers below 2^53 are exact as doubles."""
    return (queries @ vectors.T).astype(np.int64) if exact else queries.astype(np.int64) @ vectors.astype(np.int64).T


class Best:
    """The k best (score, vec_id) of each query so far, and the k-th score or what is known to be below it."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.score = np.full((len(ids), k), LOWEST)
        self.vec_id = np.zeros((len(ids), k), np.int64)

    def add(self, place: np.ndarray, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Merges scores of the queries place[row]; the order is by score, then by id."""
        held, n = self.score[place] > LOWEST, np.arange(len(place))
        row = np.concatenate([np.repeat(n, held.sum(1)), row])
        score = np.concatenate([self.score[place][held], score])
        vec_id = np.concatenate([self.vec_id[place][held], vec_id])
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = rank < self.k
        self.score[place[row[top]], rank[top]] = score[top]
        self.vec_id[place[row[top]], rank[top]] = vec_id[top]
        self.floor[place] = np.maximum(self.floor[place], self.score[place, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, scores and ids of all that is held."""
        x, y = np.nonzero(self.score > LOWEST)
        return x, self.score[x, y], self.vec_id[x, y]


def verify(best: Best, place: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Adds what can be among the k best: at most 2k rows of each query, however many scores tie."""
    scores = np.where(ids[None, :] == best.ids[place][:, None], LOWEST, scores)
    if scores.shape[1] > best.k:
        kth = np.partition(scores, -best.k, 1)[:, -best.k]
        best.floor[place] = np.maximum(best.floor[place], kth)
    floor = best.floor[place][:, None]
    ties = scores == floor
    ties &= ties.cumsum(1) <= best.k
    x, y = np.nonzero(((scores > floor) | ties) & (scores > LOWEST))
    best.add(place, x, scores[x, y], ids[y])


def by_coordinates(bucket: Bucket, unit: np.ndarray, local: float, most: int) -> np.ndarray | None:
    """Places of the vectors whose cosine with a unit vector can reach the local threshold, or None
    if more than `most` are left."""
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    half = np.sqrt(max(0.0, 1 - local**2) * np.maximum(0, 1 - unit[focus] ** 2)) + SLACK
    low, high = local * unit[focus] - half, local * unit[focus] + half
    # Nearer than the threshold up to the query itself: the interval reaches the query's own value,
    # or the end of the axis where the cap around the query holds the axis.
    low, high = np.where(unit[focus] <= -local, -1 - SLACK, low), np.where(unit[focus] >= local, 1 + SLACK, high)
    ends = [(np.searchsorted(v, a, "left"), np.searchsorted(v, b, "right")) for (_, v), a, b in zip(map(bucket.axis, focus), low, high, strict=True)]
    least = min(range(len(focus)), key=lambda i: ends[i][1] - ends[i][0])
    if ends[least][1] - ends[least][0] > 4 * most:
        return None
    found = bucket.axis(focus[least])[0][slice(*ends[least])]
    for i, axis in enumerate(focus):
        if i != least:
            value = bucket.vectors[found, axis] / np.maximum(bucket.norms[found], 1e-300)
            found = found[(value >= low[i]) & (value <= high[i])]
    return np.sort(found) if len(found) <= most else None


def search(bucket: Bucket, vectors: np.ndarray, norms: np.ndarray, best: Best, exact: bool) -> dict[str, int]:
    """One bucket for all queries; returns how many products each way of pruning left."""
    done = {"length": 0, "coordinate": 0}
    reach = norms * bucket.top * (1 + SLACK)
    active = np.flatnonzero((reach >= best.floor) | (best.floor <= 0))  # zero lengths reach zero
    for at in range(0, len(active), BLOCK):
        block, rest = active[at : at + BLOCK], []
        need = np.where(norms[block] > 0, best.floor[block] / np.maximum(norms[block], 1e-300), 0) * (1 - SLACK)
        for q, least in zip(block.tolist(), need.tolist(), strict=True):
            local = least / max(bucket.top, 1e-300)
            found = None
            if local > 0.7:  # below, the intervals leave nearly the whole axis
                found = by_coordinates(bucket, vectors[q] / norms[q], min(local, 1.0), len(bucket.ids) // GATHER)
            if found is None:
                rest.append(q)
            elif len(found):
                done["coordinate"] += len(found)
                verify(best, np.array([q]), products(vectors[q : q + 1], bucket.vectors[found], exact), bucket.ids[found])
        if rest:
            place = np.array(rest)
            least = np.where(norms[place] > 0, best.floor[place] / np.maximum(norms[place], 1e-300), 0).min()
            long = bucket.norms >= least * (1 - SLACK)
            held, ids = (bucket.vectors, bucket.ids) if long.all() else (bucket.vectors[long], bucket.ids[long])
            if len(ids):
                done["length"] += len(place) * len(ids)
                verify(best, place, products(vectors[place], held, exact), ids)
    return done


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _run(asked: pd.DataFrame, run: pd.DataFrame, k: int) -> tuple[np.ndarray, Best]:
    """All buckets of a run, the longest first."""
    asked = asked.sort_values("place")
    vectors, norms = _matrix(asked["x"]), asked["norm"].to_numpy()
    best = Best(asked["vec_id"].to_numpy(), asked["floor"].to_numpy(), k)
    exact = float(norms.max()) * float(run["norm"].max()) < 2.0**52
    if not exact:  # beyond 2^53 a double loses the last digits
        vectors = np.stack(asked["x"].to_list())
    for _, rows in run.groupby("bucket", sort=True):
        held = _matrix(rows["x"]) if exact else np.stack(rows["x"].to_list())
        search(Bucket(rows["vec_id"].to_numpy(), held, rows["norm"].to_numpy()), vectors, norms, best, exact)
    return asked["place"].to_numpy(), best


def whole(embeddings: DataFrame, scale: int, is_query: Column) -> DataFrame:
    """vec_id, x (the floor of scale times each component), norm, asks; equal rows once."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LONGEST))
    rows = embeddings.where(F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)) & F.col("vec_id").isNotNull())
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id", "x").agg(F.max("asks").alias("asks"))
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("norm", F.sqrt(squares)).where(F.col("norm") < LONGEST)


def top_products(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each row that `is_query` names.

    Exact; ties go to the smaller vec_id. Rows with a null vec_id, or a vector that is null, empty or
    holds null or non-finite components, take no part; neither do rows whose length differs from the
    longest one, or of a length of 2^31 or more after scaling. Rows with the same vec_id and
    vector count once; rows with the same vec_id and other vectors are no candidates of each other,
    and each of them that asks has its own ranks. An empty table gives no rows; columns besides
    vec_id, embedding and those in `is_query` are not read.

    A task holds at most RUN * BUCKET vectors and QUERIES queries; a vector is copied once per
    QUERIES queries, a query once per run that its threshold does not rule out. To the driver come
    row counts and SPANS lengths.
    """
    spark = embeddings.sparkSession
    rows = keep(whole(embeddings, scale, is_query), "whole")
    facts = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n")).first()
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    if not facts["n"]:
        return empty
    rows = rows.where(F.size("x") == facts["dim"])
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(width, F.desc("norm"), "vec_id", "x").sortWithinPartitions(F.desc("norm"), "vec_id", "x")
    ordered = numbered(ordered, "number", "by-length").withColumn("bucket", F.floor(F.col("number") / BUCKET).cast("int"))
    buckets = ceil(ordered.count() / BUCKET)
    # Buckets of a run: fewer for wide vectors, and where there are more tasks than runs.
    run = max(1, min(RUN, CELLS // (BUCKET * facts["dim"]), ceil(buckets / width)))
    runs = ceil(buckets / run)
    ordered = ordered.withColumn("run", F.floor(F.col("bucket") / run).cast("int"))

    asked = ordered.where("asks").select("vec_id", "x", "norm")
    asked = keep(numbered(asked, "place", "asked").withColumn("part", F.floor(F.col("place") / QUERIES).cast("int")), "queries")
    parts = ceil(asked.count() / QUERIES)
    if not parts:
        return empty

    def held(rows: DataFrame) -> DataFrame:
        """Vectors for each part of the queries."""
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def first(asks: pd.DataFrame, longest: pd.DataFrame) -> pd.DataFrame:
        place, best = _run(asks, longest, k)
        return pd.DataFrame({"place": place, "floor": best.floor})

    def found(asks: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(run):
            return pd.DataFrame({"place": [], "score": [], "vec_id": []}).astype("int64")
        place, best = _run(asks, run, k)
        x, score, vec_id = best.rows()
        return pd.DataFrame({"place": place[x], "score": score, "vec_id": vec_id})

    # The first bucket is one of every part's; its vectors give each query a threshold to begin with.
    opening = asked.withColumn("floor", F.lit(LOWEST)).groupBy("part").cogroup(held(ordered.where("bucket = 0")).groupBy("part"))
    floors = keep(opening.applyInPandas(first, "place bigint, floor bigint"), "floors")
    asked = asked.join(floors, "place")

    # Greatest length from each step of runs on: a query goes to the runs before the first step
    # whose vectors are all too short for its threshold.
    step = ceil(runs / SPANS)
    tops = ordered.groupBy(F.floor(F.col("run") / step).cast("int").alias("span")).agg(F.max("norm").alias("top")).orderBy("span").collect()
    tops = F.array(*[F.lit(r["top"] * (1 + SLACK)) for r in tops])
    spans = F.when(F.col("floor") <= 0, F.size(tops)).otherwise(F.size(F.filter(tops, lambda t: t * F.col("norm") >= F.col("floor"))))
    visits = asked.withColumn("last", F.least(spans * step, F.lit(runs)) - 1).where("last >= 0")
    visits = visits.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("last"))))
    visits = visits.select("run", "part", "place", "vec_id", "x", "norm", "floor")
    met = visits.groupBy("run", "part").cogroup(held(ordered.select("run", "bucket", "vec_id", "x", "norm")).groupBy("run", "part"))
    met = met.applyInPandas(found, "place bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = asked.select("place", F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "place").select("query_id", "rank", "vec_id", "score")
