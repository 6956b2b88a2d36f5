"""Rows in order: what came before a row, and runs of neighbouring rows, for keys of any size.

Rows are dealt by ranges of (key, order), so a key with a large share of all rows spreads over as
many tasks as it needs, and a task works on its own range only. What crosses the border of two
ranges is settled among one or two rows of each range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.session import kept


def placed(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Deals rows by ranges of the order and adds `_part`, the place of a row's range among all."""
    count = () if parts is None else (parts,)
    return df.repartitionByRange(*count, *order).withColumn("_part", F.spark_partition_id())


def _folded(fold: str, one: Column, other: Column) -> Column:
    if fold == "max":
        return F.greatest(one, other)
    return F.coalesce(one, F.lit(0)) + F.coalesce(other, F.lit(0))


def with_scans(
    df: DataFrame,
    order: Sequence[str],
    values: Mapping[str, Column],
    fold: str = "max",
    inclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Adds a column per value: its maximum or sum over all rows before a row, or up to it.

    The order must tell all rows apart, or rows that it does not must not change the result. The
    dealt rows are written once, as both the ranges' totals and the rows are read from them; the
    totals are one row per range. A scan per key needs nothing more: a maximum of structs that
    begin with the key holds the latest key, and sums that end at zero for each key start anew.
    """
    places = {f"_value{i}": value for i, value in enumerate(values.values())}
    rows = kept(placed(df.withColumns(places), order, parts), "ordered")
    total = F.max if fold == "max" else F.sum
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_part").agg(*[total(v).alias(f"_total{v}") for v in places])
    carry = ranges.select(
        "_part", *[total(f"_total{v}").over(earlier).alias(f"_carry{v}") for v in places]
    )
    last = Window.currentRow if inclusive else -1
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = rows.join(carry, "_part").withColumns(
        {f"_local{v}": total(v).over(within) for v in places}
    )
    found = [
        _folded(fold, F.col(f"_local{v}"), F.col(f"_carry{v}")).alias(name)
        for v, name in zip(places, values, strict=True)
    ]
    return local.select(*df.columns, *found)


def with_scan(
    df: DataFrame,
    order: Sequence[str],
    value: Column,
    name: str,
    fold: str = "max",
    inclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """`with_scans` of one value."""
    return with_scans(df, order, {name: value}, fold, inclusive, parts)


def same_keys(keys: Sequence[str], other: str) -> Column:
    """Whether a struct column has the keys of its row; null keys are equal."""
    same = F.col(other).isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(other)[k])
    return same


def with_greatest_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    name: str,
    parts: int | None = None,
) -> DataFrame:
    """Adds a struct of columns: the greatest one among the earlier rows of the key.

    Null where there is none. Compared by the first column, then the next ones; a row with a null
    first column never counts.
    """
    value = F.when(F.col(columns[0]).isNotNull(), F.struct(*keys, F.struct(*columns).alias("_of")))
    scanned = with_scan(df, [*keys, *order], value, "_before", parts=parts)
    of_key = F.when(same_keys(keys, "_before"), F.col("_before")["_of"])
    return scanned.withColumn(name, of_key).drop("_before")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    parts: int | None = None,
) -> DataFrame:
    """Adds `previous`: a struct of columns of the row before, in the order within the key."""
    at = F.struct(*order).alias("_at")
    value = F.struct(*keys, at, F.struct(*columns).alias("_of"))
    scanned = with_scan(df, [*keys, *order], value, "_before", parts=parts)
    of_key = F.when(same_keys(keys, "_before"), F.col("_before")["_of"])
    return scanned.withColumn("previous", of_key).drop("_before")


def runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    value: str,
    linked: Callable[[Column, Column, Column, Column], Column],
    parts: int | None = None,
) -> DataFrame:
    """Maximal runs of neighbouring rows: keys, value, started_at, ended_at, n_rows.

    `linked(earlier_ts, earlier_value, ts, value)` tells whether a row continues the run of the
    row before it. All rows of a run must have the same value.

    Each range finds its own runs. The first and the last run of all ranges meet in one lane, two
    rows per range, where a run that goes on in later ranges is put together; the other runs stay
    in the lane of their range.
    """
    rows = df.select(
        *keys,
        F.col(ts).cast("timestamp").alias("_ts"),
        F.col(tie).alias("_tie"),
        F.col(value).alias("_value"),
    )
    rows = placed(rows, [*keys, "_ts", "_tie"], parts)
    part = Window.partitionBy("_part")
    local = part.orderBy(*keys, "_ts", "_tie")
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.struct(*keys, "_ts", "_value")
    goes_on = same_keys(keys, "_before") & linked(
        F.col("_before._ts"), F.col("_before._value"), F.col("_ts"), F.col("_value")
    )
    pieces = (
        rows.withColumn("_before", F.lag(before).over(local))
        .withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(so_far))
        .groupBy("_part", "_run", *keys, "_value")
        .agg(
            F.min("_ts").alias("_start"),
            F.max("_ts").alias("_end"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_border", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(part)))
        .withColumn("_lane", F.when(F.col("_border"), -1).otherwise(F.col("_part")))
    )
    lane = Window.partitionBy("_lane").orderBy("_part", "_run")
    ends = F.struct(*keys, "_end", "_value", "_part")
    joins = (
        F.col("_border")
        & same_keys(keys, "_before")
        & (F.col("_before._part") < F.col("_part"))
        & linked(F.col("_before._end"), F.col("_before._value"), F.col("_start"), F.col("_value"))
    )
    up_to = lane.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        pieces.withColumn("_before", F.lag(ends).over(lane))
        .withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        .withColumn("_group", F.sum("_new").over(up_to))
        .groupBy("_lane", "_group", *keys, "_value")
        .agg(
            F.min("_start").alias("started_at"),
            F.max("_end").alias("ended_at"),
            F.sum("_n").alias("n_rows"),
        )
        .select(*keys, F.col("_value").alias(value), "started_at", "ended_at", "n_rows")
    )
