"""Fill-in-middle transformation by a piecewise-linear learned rank index.

The unit boundaries of a text form an ascending array: the boundary of rank r stands at code point
b[r], from b[0] = 0 to b[n] = length. The index holds straight segments, each of which predicts its
boundaries within a fixed error, and the residual of every boundary. A cut is drawn as a rank; its
segment predicts the code point and the residual corrects it exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import ship

ship(__name__)

ERROR = 48  # code points by which a segment may miss a boundary before its residual is added
SENTINELS = ("<P>", "<S>", "<M>")


def line_bounds(text: str) -> list[int]:
    """Ends of the units `[^\\n]*\\n|[^\\n]+` in code points, after a leading 0."""
    ends = list(accumulate((len(line) + 1 for line in text.split("\n")), initial=0))
    ends[-1] -= 1  # the last piece has no line break
    if len(ends) > 1 and ends[-1] == ends[-2]:  # and is no unit if it is empty
        ends.pop()
    return ends


class RankIndex(NamedTuple):
    """Segments by the rank they begin at, and the residual of every rank."""

    ranks: list[int]
    starts: list[int]
    slopes: list[float]
    residuals: np.ndarray

    def at(self, rank: int) -> int:
        """The code point of a rank."""
        k = bisect_right(self.ranks, rank) - 1
        return self.starts[k] + round(self.slopes[k] * (rank - self.ranks[k])) + int(self.residuals[rank])


def fit(bounds: list[int], error: int = ERROR) -> RankIndex:
    """Longest segments from left to right. A segment starts at a boundary; every further one narrows
    the slopes that stay within the error, and the segment ends where none is left."""
    ranks, starts, slopes, spans = [], [], [], []
    first, start, low, high = 0, 0, 0.0, float("inf")

    def close(end: int) -> None:
        ranks.append(first)
        starts.append(start)
        slopes.append((low + high) / 2 if high < float("inf") else 0.0)
        spans.append(end - first)

    for rank, at in enumerate(bounds):
        if rank == first:
            continue
        steps, height = rank - first, at - start
        least, most = max(low, (height - error) / steps), min(high, (height + error) / steps)
        if least <= most:
            low, high = least, most
        else:
            close(rank)
            first, start, low, high = rank, at, 0.0, float("inf")
    close(len(bounds))
    step = np.arange(len(bounds)) - np.repeat(ranks, spans)
    predicted = np.repeat(starts, spans) + np.rint(np.repeat(slopes, spans) * step).astype(np.int64)
    return RankIndex(ranks, starts, slopes, (np.asarray(bounds) - predicted).astype(np.int32))


CUTS = "n long, prefix_chars long, middle_chars long, segments int, worst int"


def _cuts(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
    """Units of a text, the code points of its prefix and middle, and the size of its index."""
    rows = []
    for t, a, b in zip(text, one, two, strict=True):
        bounds = line_bounds(t)
        n = len(bounds) - 1
        index = fit(bounds)
        low, high = sorted((index.at(int(a) % (n + 1)), index.at(int(b) % (n + 1))))
        rows.append((n, low, high - low, len(index.ranks), int(np.abs(index.residuals).max())))
    return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "segments", "worst"])


def rebuilt(output: Column, form: Column) -> Column:
    """The text before the transformation."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output, segments, worst (largest residual).

    Two cuts, drawn by the hash of seed and doc_id among the n + 1 boundaries, part a text into
    prefix, middle and suffix; `percent` of the texts are transformed, `spm_percent` of these with
    the suffix first. Texts that are empty or hold a sentinel stay plain, with null prefix_chars and
    middle_chars. A null text counts as empty, a null doc_id as an empty number. Rows that repeat
    give rows that repeat; an empty table gives no rows; other columns than doc_id and text are not
    read. One pass without a shuffle: only the cuts come from Python.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.array(*draw).alias("draw"))
    rows = rows.withColumn("cut", F.pandas_udf(_cuts, CUTS)("text", F.col("draw")[0], F.col("draw")[1]))
    plain = (F.col("text") == "") | (F.col("draw")[2] % 100 >= percent)
    for sentinel in SENTINELS:
        plain = plain | F.contains("text", F.lit(sentinel))
    form = F.when(plain, "plain").when(F.col("draw")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), "cut.*")
    end = F.col("prefix_chars") + F.col("middle_chars")
    prefix = F.substr("text", F.lit(1), F.col("prefix_chars").cast("int"))
    middle = F.substr("text", (F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int"))
    suffix = F.substr("text", (end + 1).cast("int"))
    p, s, m = (F.lit(x) for x in SENTINELS)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )
    chars = {c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")}
    return rows.withColumn("output", output).withColumns(chars).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "segments", "worst")
