"""Removes later copies of passages, by a suffix array over lines.

A document is the sequence of its lines without blank ones. Prefix doubling ranks all suffixes by
their first 1, 2, 4, ... lines: the rank of 2n lines is the place of the pair (rank of n lines here,
rank of n lines n further on) in the sorted list of such pairs. Pairs that occur once get no rank,
as nothing repeated starts there. Suffixes that agree in their first n lines form an interval of
the suffix array with a longest common prefix of n or more; two ranks of a power of two that
overlap name it for any n.

A repeated run counts if it has `min_words` words. Each line of such a run lies in a shortest window
of so many words, taken forward from a line or back from one, that repeats with the run. So the
intervals are asked for these windows only, and ranks of more lines than the longest of them, which
are at most `min_words` lines, are never needed.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import forget, keep

BLANKS = r"^[\s]+|[\s]+$"


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"\s+"))


def _ranks(df: DataFrame, *by: str) -> DataFrame:
    """The sorted list of the values that occur more than once, with their places in it."""
    often = df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return often.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def later_copies(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """doc, text_key and the places (from 0, among all lines) of the lines to remove; a kept table.

    Of the tables written on the way none stays longer than it is read.
    """
    texts = documents.select(_doc().alias("doc"), _key().alias("text_key"), "text").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, BLANKS, "").alias("line")))
    rows = texts.select("doc", "text_key", F.posexplode(F.filter(lines, lambda x: x["line"] != "")).alias("i", "x"))
    lines = keep(rows.select("doc", "text_key", "i", F.col("x.pos").alias("pos"), F.md5(F.col("x.line").cast("binary")).alias("line"), _words(F.col("x.line")).alias("words")), "lines")
    first = keep(_ranks(lines, "line"), "ranks")
    rows = lines.join(first, "line").drop("line").dropDuplicates(["doc", "text_key", "i"])
    line = Window.partitionBy("doc", "text_key").orderBy("i")
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(line))
    island = Window.partitionBy("doc", "text_key", "island")
    rows = rows.withColumn("all_words", F.sum("words").over(island)).where(F.col("all_words") >= min_words)
    ahead = F.collect_list("words").over(island.orderBy("i").rowsBetween(0, min_words - 1))
    back = F.reverse(F.collect_list("words").over(island.orderBy("i").rowsBetween(1 - min_words, 0)))

    def shortest(counts: Column) -> Column:
        """How many of the counts it takes to reach min_words; null if all do not."""
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        step = lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n")))
        end = F.aggregate(counts, start, step)
        return F.when(end["sum"] >= min_words, end["n"])

    rows = rows.select("doc", "text_key", "i", "pos", F.col("rank").alias("r0"), ahead.alias("ahead"), back.alias("back"))
    rows = rows.select("doc", "text_key", "i", "pos", "r0", shortest(F.col("ahead")).alias("ahead"), shortest(F.col("back")).alias("back"))
    rows = keep(rows, "suffixes")
    forget(lines, first)
    longest = rows.agg(F.max(F.greatest(F.coalesce("ahead", F.lit(1)), F.coalesce("back", F.lit(1))))).first()[0] or 1
    levels = longest.bit_length()
    for k in range(1, levels):
        half = 1 << (k - 1)
        next_i, next_rank = F.lead("i", half).over(line), F.lead(f"r{k - 1}", half).over(line)
        pairs = rows.withColumn("right", F.when(next_i == F.col("i") + half, next_rank)).withColumn("left", F.col(f"r{k - 1}"))
        whole = pairs.where("left is not null and right is not null")
        ranks = keep(_ranks(whole, "left", "right"), "ranks")
        named = ranks.withColumnRenamed("rank", f"r{k}")
        longer = keep(pairs.join(named, ["left", "right"], "left").drop("left", "right"), "suffixes")
        forget(rows, ranks)
        rows = longer
    ranked = rows.select("doc", "text_key", "i", F.array(*[f"r{k}" for k in range(levels)]).alias("r"))
    windows = rows.select("doc", "text_key", F.col("i").alias("start"), F.col("ahead").alias("n")).unionByName(
        rows.select("doc", "text_key", (F.col("i") - F.col("back") + 1).alias("start"), F.col("back").alias("n"))
    )
    windows = windows.where("n is not null").distinct().withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    windows = windows.withColumn("second", F.expr("start + n - shiftleft(1, k)"))
    at = F.col("k") + 1
    windows = windows.join(ranked.withColumnRenamed("i", "start"), ["doc", "text_key", "start"]).withColumn("a", F.element_at("r", at)).drop("r")
    windows = windows.join(ranked.withColumnRenamed("i", "second"), ["doc", "text_key", "second"]).withColumn("b", F.element_at("r", at)).drop("r")
    windows = keep(windows.where("a is not null and b is not null").select("doc", "text_key", "start", "n", "a", "b"), "windows")
    place = F.struct("doc", "text_key", "start")
    first = windows.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = windows.join(first, ["n", "a", "b"])
    other = (F.col("doc") != F.col("first.doc")) | (F.col("text_key") != F.col("first.text_key"))
    later = later.where(other | (F.col("start") >= F.col("first.start") + F.col("n")))
    gone = later.select("doc", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i")).distinct()
    gone = gone.join(rows.select("doc", "text_key", "i", "pos"), ["doc", "text_key", "i"])
    gone = keep(gone.groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    forget(rows, windows)
    return gone


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _key() -> Column:
    return F.xxhash64("text")


def dedup(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """All rows and columns, with shortened texts, and n_removed, the number of lines removed.

    Copies are compared line by line without white space at the ends; blank lines stay where they
    are. The first copy, by doc_id and place, keeps its lines; a later one that overlaps it too.
    A document may lose all its text, its row stays. Null and empty texts stay as they are. Rows
    that agree in doc_id and text count as one and get the same result; null ids come first. An
    empty table gives no rows. A column named n_removed is replaced; other columns pass through.
    """
    taken = {c.lower() for c in documents.columns}
    doc, key, gone = (next(n for n in (x + "_" * i for i in range(len(taken) + 1)) if n not in taken) for x in ("_doc", "_key", "_gone"))
    found = later_copies(documents, min_words).withColumnsRenamed({"doc": doc, "text_key": key, "gone": gone})
    # One way at every size: both sides are dealt by document, however few lines go.
    rows = documents.drop("n_removed").withColumns({doc: _doc(), key: _key()}).join(found.hint("merge"), [doc, key], "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return rows.withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))).drop(doc, key, gone)
