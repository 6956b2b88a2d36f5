"""Reproducible random order, and the first rows of it, without sorting the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH = "_order_hash"
_HEX_DIGITS = 12
_SPACE = float(16**_HEX_DIGITS)
_ALL = "g"  # sorts after every hex digit


def order_hash(seed: int, key: Column) -> Column:
    """Position of a row in the stream of a seed. The key must be unique and not null."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in the order of the seed; a range-partitioned sort, independent of layout."""
    return df.orderBy(order_hash(seed, F.col(key)), F.col(key))


def _bound(quota: int | Column, rows: Column) -> Column:
    """Hash prefix below which `quota` of `rows` uniform hashes lie, with eight sigmas to spare."""
    quota = F.lit(quota)
    share = (quota + F.lit(8.0) * F.sqrt(quota) + F.lit(64.0)) / rows
    prefix = F.lower(F.lpad(F.hex((share * _SPACE).cast("bigint")), _HEX_DIGITS, "0"))
    return F.when((rows == 0) | (share >= 1.0), F.lit(_ALL)).otherwise(prefix)


def thin(
    df: DataFrame, quotas: Mapping[str, int | Column], group: Column | None = None
) -> DataFrame:
    """Rows that can be among the first `quota` of their group in hash order, and few others.

    A top-n over a very wide table sends n rows of every task to one task. Hashes are uniform,
    so a bound per group follows from its row count; a second count over the key column proves
    that enough rows lie below the bound, and otherwise the bound is dropped. Both counts are
    scalar subqueries that shuffle one row per task. `df` carries the order hash; groups
    without a quota are left out. A quota may be a scalar subquery itself.
    """
    group = F.lit("") if group is None else group
    names = list(quotas)
    sizes = df.agg(*[F.count_if(group == g).alias(f"n{i}") for i, g in enumerate(names)])
    guess = sizes.select(
        F.struct(*[_bound(quotas[g], F.col(f"n{i}")).alias(f"b{i}") for i, g in enumerate(names)])
    ).scalar()
    below = df.agg(
        *[F.count_if(group == g).alias(f"n{i}") for i, g in enumerate(names)],
        *[
            F.count_if((group == g) & (F.col(HASH) < guess[f"b{i}"])).alias(f"k{i}")
            for i, g in enumerate(names)
        ],
    )
    proven = below.select(
        F.struct(
            *[
                F.when(
                    F.col(f"k{i}") >= F.least(F.lit(quotas[g]), F.col(f"n{i}")), guess[f"b{i}"]
                )
                .otherwise(_ALL)
                .alias(f"b{i}")
                for i, g in enumerate(names)
            ]
        )
    ).scalar()
    keep = F.lit(False)
    for i, g in enumerate(names):
        keep = keep | ((group == g) & (F.col(HASH) < proven[f"b{i}"]))
    return df.where(keep)


def _placed(
    df: DataFrame, group: Sequence[str], key: str, quota: Column | None, bounded: bool
) -> DataFrame:
    """Adds `rank`, the place in hash order within the group, and keeps those up to the quota.

    Rows are counted per group and hash bin, and numbered inside their bin only, on top of the
    rows in the bins before, so that a large group is numbered by many tasks. There are 65,536
    bins per group; `bounded` says that there are few groups, so that the counts can be sent.
    """
    rows = df.withColumn("_bin", F.substring(HASH, 1, 4))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        rows.groupBy(*group, "_bin")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    if quota is not None:
        bins = bins.where(F.col("_before") < quota)
    named = {name: f"_of_{name}" for name in (*group, "_bin")}
    same = F.lit(True)
    for mine, other in named.items():
        same = same & F.col(mine).eqNullSafe(F.col(other))
    bins = bins.withColumnsRenamed(named)
    within = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(HASH, key))
    placed = rows.join(F.broadcast(bins) if bounded else bins, same).withColumn(
        "rank", F.col("_before") + within
    )
    if quota is not None:
        placed = placed.where(F.col("rank") <= quota)
    return placed.drop("_bin", "_before", *named.values())


def ranked(
    df: DataFrame, quotas: Mapping[str, int | Column], key: str, group: Column | None = None
) -> DataFrame:
    """The first `quota` rows of each group in hash order with their `rank`, for any quotas."""
    named = df.withColumn("_group", F.lit("") if group is None else group)
    few = thin(named, quotas, F.col("_group"))
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    wanted = F.element_at(quota, F.col("_group"))
    return _placed(few, ["_group"], key, wanted, bounded=True).drop("_group")


def ranked_each(df: DataFrame, group: str, quota: int, key: str) -> DataFrame:
    """The first `quota` rows of every group in hash order with their `rank`, for any groups."""
    return _placed(df, [group], key, F.lit(quota), bounded=False)


def _prefix(df: DataFrame, n: int | None, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn(HASH, order_hash(seed, F.col(key)))
    if n is None:
        return _placed(hashed, [], key, None, bounded=True)
    return ranked(hashed, {"": n}, key)


def scan_prefix(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """The first n rows in the order of the seed, before any filter. Carries the order hash."""
    return _prefix(df, n, key, seed).drop("rank").orderBy(HASH, key)


def stream(df: DataFrame, n: int | None, key: str, seed: int) -> DataFrame:
    """The first n rows of the seeded stream with `stream_idx`, their 0-based positions in it; all
    rows where n is None."""
    place = (F.col("rank") - 1).cast("bigint")
    return _prefix(df, n, key, seed).withColumn("stream_idx", place).drop("rank", HASH)
