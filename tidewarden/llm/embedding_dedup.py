"""Near duplicates of vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codes form a product grid, and a
vector lies in the cell of its two nearest codes. A search visits cells in the order of a lower
bound of their distance: a vector nearer to code i than to the query's own code lies beyond the
plane midway between both. It stops where the bound exceeds the distance that the threshold allows,
so the recall reached is one. Vectors of visited cells are verified.

Cells see each other, so a vector visits only its own cell and those after it, and a link counts for
both. Cells in a row form a group of bounded size; a vector is sent once to a group, however many of
its cells it visits, and there compared tile by tile, without tiles that the bounds rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import forget, keep, ship
from tidewarden.llm.graph import components
from tidewarden.llm.vectors import stack, usable

ship(__name__)

CODES = 32  # of each half: a grid of 1,024 cells
SAMPLE = 8_000  # vectors at most that the codebooks are fitted on
GROUP = 8_192  # vectors of a group of cells at most
PART = 16_384  # visitors of a group that meet in one task, about
TILE = 1_024  # vectors of either side that are compared at once


def codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread starting points."""
    centres = points[np.random.default_rng(3).choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(rounds):
        own = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1))


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code, and for each code the least squared distance of a vector that has it."""
    d = distances(points, centres)
    own = d.argmin(1)
    apart = np.sqrt(distances(centres, centres))[own]
    gap = (d - d[np.arange(len(d)), own][:, None]) / (2 * np.maximum(apart, 1e-12))
    return own, np.where(apart > 0, np.maximum(0, gap), 0) ** 2


def visit(first: np.ndarray, second: np.ndarray, own: np.ndarray, limit: float) -> np.ndarray:
    """For each vector and cell whether it visits: each code of the first half with the codes of the
    second while the sum of their bounds stays within the limit, from the vector's own cell on."""
    near = (first[:, :, None] + second[:, None, :] <= limit).reshape(len(first), -1)
    return near & (np.arange(near.shape[1]) >= own[:, None])


def groups(sizes: np.ndarray, most: int) -> np.ndarray:
    """The first cell of each group. Cells in a row share a group of at most `most` vectors; a larger
    cell has groups of its own, which all begin with it."""
    starts, held = [], most + 1
    for cell, n in enumerate(sizes.tolist()):
        if held + n > most:
            starts += [cell] * max(1, -(-n // most))
            held = 0
        held += n
    return np.array(starts)


def unit(column) -> np.ndarray:
    rows = stack(column)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def roots(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each left id, then each right id, the least id that the hits (x[i], y[i]) connect it with."""
    ids, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = place[: len(left)][x], place[len(left) :][y]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return ids[label[place]]
        label = new


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with
    nothing, and so are rows with a null vec_id and vectors whose length differs from the longest.
    Equal vectors form a class first; a class counts its members, so copies never meet. An empty
    table gives no rows; columns besides vec_id and embedding are not read.
    """
    every = embeddings.select("vec_id", "embedding")
    rows = every.where(usable("embedding") & F.col("vec_id").isNotNull())
    dim = rows.agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    rows = rows.where(F.size("embedding") == dim)
    classes = keep(rows.groupBy("embedding").agg(F.min("vec_id").alias("a"), F.count("*").alias("k")), "classes")
    sample = classes.select("embedding").orderBy(F.xxhash64("a"), "a").limit(SAMPLE).collect()
    if not sample:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    points, half = unit(r["embedding"] for r in sample), dim // 2
    books = codebook(points[:, :half], CODES), codebook(points[:, half:], CODES)
    limit = 2 * (1 - cosine) + 1e-9
    width = len(books[1])

    def located(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (i1, b1), (i2, b2) = bounds(points[:, :half], books[0]), bounds(points[:, half:], books[1])
        return i1 * width + i2, b1, b2

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), TILE):
                yield pd.DataFrame({"cell": located(unit(batch["embedding"][i : i + TILE]))[0]})

    sizes = np.zeros(len(books[0]) * width, np.int64)
    for r in classes.select("embedding").mapInPandas(place, "cell bigint").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]  # of CODES * CODES cells at most
    starts = groups(sizes, GROUP)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The group that holds a vector, and those that it visits."""
        for batch in batches:
            for i in range(0, len(batch), TILE):
                part = batch[i : i + TILE]
                cell, one, two = located(unit(part["embedding"]))
                visits = np.logical_or.reduceat(visit(one, two, cell, limit), starts, axis=1)
                end = np.searchsorted(starts, cell, "right")
                begin = np.searchsorted(starts, starts[end - 1], "left")
                home = begin + part["salt"].to_numpy() % (end - begin)
                yield part[["a", "k", "embedding"]].assign(cell=cell, home=home, visits=[np.flatnonzero(v) for v in visits])

    salted = classes.select("*", F.shiftrightunsigned(F.xxhash64("a"), 1).alias("salt"))
    sent = keep(salted.mapInPandas(send, "a bigint, k bigint, embedding array<float>, cell bigint, home bigint, visits array<bigint>"), "sent")
    asks = sent.select(F.explode("visits").alias("group"), "a", "k", "embedding", "cell")
    parts = asks.groupBy("group").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # one row per group
    asks = asks.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    again = sent.sparkSession.read.schema(sent.schema).parquet(sent.kept_at)
    held = again.select(F.col("home").alias("group"), "a", "k", "embedding", "cell").join(parts, "group")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def verify(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "links": [], "b": []}).astype("int64")]
        if not len(asked) or not len(held):
            return out[0]
        asked, held = asked.sort_values(["cell", "a"]), held.sort_values(["cell", "a"])
        points = unit(held["embedding"])
        to, size, at = (held[c].to_numpy() for c in ("a", "k", "cell"))
        for i in range(0, len(asked), TILE):
            part = asked[i : i + TILE]
            left, k, cell = (part[c].to_numpy() for c in ("a", "k", "cell"))
            asking = unit(part["embedding"])
            _, one, two = located(asking)
            seen = visit(one, two, cell, limit).any(0)
            for j in range(0, len(held), TILE):
                tile = slice(j, j + TILE)
                if not seen[at[tile]].any():
                    continue
                x, y = np.nonzero(asking @ points[tile].T >= cosine)
                after = cell[x] < at[tile][y]
                some = after | ((cell[x] == at[tile][y]) & (left[x] != to[tile][y]))
                x, y, after = x[some], y[some], after[some]
                links = [np.bincount(x, size[tile][y], len(left)), np.bincount(y[after], k[x[after]], len(to[tile]))]
                ids = np.concatenate([left, to[tile]])
                rows = pd.DataFrame({"a": ids, "links": np.concatenate(links).astype("int64"), "b": roots(x, y, left, to[tile])})
                out.append(rows[(rows["links"] > 0) | (rows["a"] != rows["b"])])  # all that hang together
        return pd.concat(out)

    keys = ("group", "part")
    found = asks.drop("parts").groupBy(*keys).cogroup(held.drop("parts").groupBy(*keys))
    found = keep(found.applyInPandas(verify, "a bigint, links bigint, b bigint"), "found")
    forget(sent)
    final = components(found.select("a", "b")).withColumnRenamed("node", "a")
    named = classes.join(found.groupBy("a").agg(F.sum("links").alias("links")), "a", "left").join(final, "a", "left")
    named = named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("links"), F.coalesce("component", "a").alias("component"))
    out = every.withColumn("key", F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.col("embedding"))).select("vec_id", "key")
    out = out.join(named.withColumnRenamed("embedding", "key"), "key", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))
