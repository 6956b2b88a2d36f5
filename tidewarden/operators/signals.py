"""Countable behaviour in a message log: pile-ons, repeats, messages after a stop request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import text, times
from tidewarden.operators import ordered

WEEK_MINUTES = 7 * 24 * 60


def pile_on(
    messages: DataFrame,
    target: str = "target_id",
    user: str = "user_id",
    min_users: int = 3,
    minutes: int = 10,
    parts: int | None = None,
) -> DataFrame:
    """Messages by which at least `min_users` users hit one target in the closed window before.

    A user's messages with no gap longer than the window form a run, and the user counts from its
    start until the window's length after its end. Starts, messages and ends of a target in order
    make the number of users a running sum, which is zero again after the last end. Both the runs
    and the sum go over ranges of rows, so one target, user, hour or instant with a large share of
    the log spreads over many tasks. Messages without a target never count; those without a user
    are judged but count as nobody.
    """
    aimed = messages.where(F.col(target).isNotNull())
    log = aimed.where(F.col(user).isNotNull()).withColumn("_one", F.lit(1))

    def linked(earlier: Column, _, later: Column, __) -> Column:
        return times.minutes_between(earlier, later) <= minutes

    active = ordered.runs(log, [target, user], "ts", "event_id", "_one", linked, parts)
    over = F.col("ended_at") + F.expr(f"INTERVAL {minutes} MINUTES")
    # At one instant: starts (0), then messages (1), then ends (2), as the window is closed.
    steps = F.array(
        F.struct(F.col("started_at").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_delta")),
        F.struct(over.alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).alias("_delta")),
    )
    said = aimed.withColumns(
        {"_at": F.col("ts").cast("timestamp"), "_kind": F.lit(1), "_delta": F.lit(0)}
    )
    line = active.select(target, F.inline(steps)).unionByName(said, allowMissingColumns=True)
    counted = ordered.with_scan(
        line, [target, "_at", "_kind", "event_id"], F.col("_delta"), "n_users", "sum", parts=parts
    )
    kept = [c for c in messages.columns if c not in ("ts", target)]
    return counted.where((F.col("_kind") == 1) & (F.col("n_users") >= min_users)).select(
        target, F.col("_at").alias("ts"), *kept, F.col("n_users").cast("int").alias("n_users")
    )


def continued_after_stop(
    messages: DataFrame, user: str = "user_id", target: str = "target_id"
) -> DataFrame:
    """Messages to somebody who has asked their author to stop, from that instant on.

    The request goes the other way: its author is the target of the messages, and its target is
    their author. Requests to stop are no messages of this kind themselves.
    """
    asked = (
        messages.where("is_stop")
        .groupBy(F.col(user).alias("_asking"), F.col(target).alias("_asked"))
        .agg(F.min("ts").alias("stopped_at"))
    )
    told = (F.col(target) == F.col("_asking")) & (F.col(user) == F.col("_asked"))
    later = F.col("ts") > F.col("stopped_at")
    return messages.where(~F.col("is_stop")).join(asked, told & later).drop("_asking", "_asked")


def repeat_streak(
    messages: DataFrame, keys: Sequence[str], message: str, at_least: int = 3
) -> DataFrame:
    """Runs of the same message posted again and again by one user."""
    return ordered.runs(
        messages, keys, "ts", "event_id", message, lambda _, a, __, b: a == b
    ).where(F.col("n_rows") >= at_least)


def off_topic_run(
    messages: DataFrame, keys: Sequence[str], flag: str = "is_off_topic", more_than: int = 5
) -> DataFrame:
    """Runs of more than five flagged messages in a row."""
    return (
        ordered.runs(messages, keys, "ts", "event_id", flag, lambda _, a, __, b: a == b)
        .where(F.col(flag) & (F.col("n_rows") > more_than))
        .drop(flag)
    )


def repeat_in_message(df: DataFrame, column: str, at_least: int = 3) -> DataFrame:
    """Texts in which one line stands several times in a row."""
    return df.withColumn("line_run", text.longest_line_run(F.col(column))).where(
        F.col("line_run") >= at_least
    )


def repeat_across_threads(
    df: DataFrame, column: str, thread: str, at_least: int = 3
) -> DataFrame:
    """Texts posted several times and in more than one thread, with both numbers.

    Rows without a text or with an empty one say nothing and are left out; a null thread is none.
    """
    said = df.where(F.col(column) != "")
    return (
        said.groupBy(F.sha2(column, 256).alias("text_hash"))
        .agg(F.count(F.lit(1)).alias("n_posts"), F.count_distinct(thread).alias("n_threads"))
        .where((F.col("n_posts") >= at_least) & (F.col("n_threads") > 1))
    )


def once_per_week(messages: DataFrame, user: Sequence[str], promo: Column) -> DataFrame:
    """Promotions less than seven days after the user's last one."""
    chained = ordered.with_previous(messages.where(promo), user, ["ts", "event_id"], ["ts"])
    since = times.minutes_between(F.col("previous.ts"), F.col("ts"))
    return (
        chained.withColumn("minutes_since", since)
        .where(F.col("minutes_since") < WEEK_MINUTES)
        .drop("previous")
    )
